"""Markdown links, anchors and code spans as Column functions over whole documents.

Spans of code and blocks are native expressions, which most documents leave at a first test;
links and comments, which most documents have, are found by one scan outside the JVM.

Offsets count code points, ends are exclusive.  Links are matched on the raw text and then
dropped by where they start; text is never masked first.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkgraph.functions.paths import BLANK
from linkgraph.functions.scan import Pattern, scanner

# Fixed patterns of the format.  Runs that can't be given back are possessive.
UUID = "[0-9a-fA-F-]{36}"
_HREF = rf"(?:(?:[^(){BLANK}]++|\((?:[^(){BLANK}]++|\([^(){BLANK}]*+\))*+\))++|[^)]+)"
_LINK = rf"\[([^\]]*)\]\(({_HREF})\)"
_ATTRS = r'\{(?:[^{}"\n]++|"[^"\n]*+")*+\}'
_COMMENT = rf"<!--[{BLANK}]*uuid:[{BLANK}]*({UUID})[{BLANK}]*-->"
ROBUST = rf"{_LINK}({_ATTRS})?[{BLANK}]*{_COMMENT}"
PLAIN = rf"{_LINK}(?=({_ATTRS})?([{BLANK}]*{_COMMENT})?)"
WEB = rf"{_LINK}(?=([{BLANK}]*<!--[{BLANK}]*web-uuid:[{BLANK}]*({UUID})[{BLANK}]*-->)?+([ \t]*<!--[{BLANK}]*%s-own-exempt[{BLANK}]*-->)?)"
#: Line breaks at which fences are looked for; line numbers count line feeds only.
_BREAK = r"\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029"
_LINE = rf"[^{_BREAK}]*(?:\r\n|[{_BREAK}])|[^{_BREAK}]+"
_TICKS = r"(?s)(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"

SPANS = "array<struct<s:int,e:int>>"
#: What scans find, by name; %s in a pattern is the prefix of opt-out markers.
KINDS = {
    "robust": Pattern(ROBUST, {"text": 1, "href": 2, "attrs": 3, "uuid": 4}, "uuid:"),
    "links": Pattern(PLAIN, {"text": 1, "href": 2, "attrs": 3, "tail": 4, "uuid": 5}, "]("),
    "comments": Pattern(_COMMENT, {"uuid": 1}, "uuid:"),
    "web": Pattern(WEB, {"text": 1, "href": 2, "tail": 3, "uuid": 4, "exempt": 5}, "http"),
}


def none(kind: str) -> Column:
    return F.array().cast(kind)


def scanned(text: Column, pattern: str, /, **groups: int) -> Column:
    """All matches of pattern in order: array<struct<s, e, line int, before, all, *groups string>>.

    line counts from 1; before is what stands between the match before and this one; a group
    that took no part is empty.
    """
    every = {"all": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))} | {name: F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for name, k in groups.items()}
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(every["all"]))
    rows = F.arrays_zip(pieces.alias("before"), *[v.alias(k) for k, v in every.items()])
    fields = ["before", *every]
    kind = f"array<struct<s:int,e:int,line:int,{','.join(f'{x}:string' for x in fields)}>>"
    feeds = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n")))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.char_length(row["before"])
        end, line = start + F.char_length(row["all"]), state["line"] + feeds(row["before"])
        found = F.struct(start.alias("s"), end.alias("e"), line.alias("line"), *[row[x].alias(x) for x in fields])
        return F.struct(end.alias("at"), (line + feeds(row["all"])).alias("line"), F.concat(state["out"], F.array(found)).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), none(kind).alias("out")), step, lambda state: state["out"])


def inside(at: Column, spans: Column) -> Column:
    return F.exists(spans, lambda x: (x["s"] <= at) & (at < x["e"]))


def fenced_spans(text: Column) -> Column:
    """Blocks between lines of three or more backticks or tildes; an open one goes to the end."""
    lines = F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))

    def step(state: Column, line: Column) -> Column:
        end = state["at"] + F.char_length(line)
        opener = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})", 1)
        closer = F.regexp_extract(line, rf"^ {{0,3}}(`{{3,}}|~{{3,}})[{BLANK}]*$", 1)
        closes = (state["fence"] != "") & (F.substring(closer, 1, 1) == F.substring(state["fence"], 1, 1)) & (F.char_length(closer) >= F.char_length(state["fence"]))
        opens = (state["fence"] == "") & (opener != "")
        return F.struct(
            end.alias("at"), F.when(closes, F.lit("")).when(opens, opener).otherwise(state["fence"]).alias("fence"), F.when(opens, state["at"]).otherwise(state["start"]).alias("start"),
            F.when(closes, F.concat(state["out"], F.array(F.struct(state["start"].alias("s"), end.alias("e"))))).otherwise(state["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("fence"), F.lit(0).alias("start"), none(SPANS).alias("out"))
    last = lambda s: F.when(s["fence"] != "", F.concat(s["out"], F.array(F.struct(s["start"].alias("s"), s["at"].alias("e"))))).otherwise(s["out"])
    return F.when(text.contains("```") | text.contains("~~~"), F.aggregate(lines, zero, step, last)).otherwise(none(SPANS))


def inline_spans(text: Column, fenced: Column) -> Column:
    """Between equally long runs of backticks, within the segments that fences leave."""
    ends = F.concat(fenced, F.array(F.struct(F.char_length(text).alias("s"), F.char_length(text).alias("e"))))
    starts = F.concat(F.array(F.lit(0)), F.transform(fenced, lambda x: x["e"]))
    segments = F.arrays_zip(starts.alias("s"), F.transform(ends, lambda x: x["s"]).alias("e"))

    def found(x: Column) -> Column:
        return F.transform(scanned(F.substring(text, x["s"] + 1, x["e"] - x["s"]), _TICKS), lambda m: F.struct((m["s"] + x["s"]).alias("s"), (m["e"] + x["s"]).alias("e")))

    return F.when(text.contains("`"), F.flatten(F.transform(segments, found))).otherwise(none(SPANS))


def code_spans(text: Column) -> Column:
    fenced = fenced_spans(text)
    return F.concat(fenced, inline_spans(text, fenced))


def block_spans(text: Column, names: tuple[str, ...]) -> Column:
    """Generated blocks: from ``<!-- NAME-start -->`` to the next ``<!-- NAME-end -->``."""
    out = none(SPANS)
    for name in names:
        pattern = rf"(?s)<!--[{BLANK}]*{re.escape(name)}-start[{BLANK}]*-->.*?<!--[{BLANK}]*{re.escape(name)}-end[{BLANK}]*-->"
        out = F.concat(out, F.transform(scanned(text, pattern), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))))
    return out


def carries_marker(text: Column, marker: str, code: Column) -> Column:
    """Whether ``<!-- marker -->`` stands outside code; code is looked at only where the word occurs at all."""
    hits = scanned(text, rf"<!--[{BLANK}]*{re.escape(marker)}[{BLANK}]*-->")
    return F.when(text.contains(marker), F.exists(hits, lambda m: ~inside(m["s"], code))).otherwise(F.lit(False))


def scan(text: Column, kinds: tuple[str, ...] = tuple(KINDS), prefix: str = "linkgraph") -> Column:
    """struct with the matches of each of KINDS that is asked for, wherever they stand."""
    return scanner({k: replace(KINDS[k], pattern=KINDS[k].pattern.replace("%s", re.escape(prefix))) for k in kinds})(text)


def robust_links(found: Column, spans: Column) -> Column:
    """From scan: links with a uuid comment, outside spans."""
    return F.filter(found["robust"], lambda m: ~inside(m["s"], spans))


def plain_links(found: Column, spans: Column) -> Column:
    """From scan: links without a uuid comment, outside spans."""
    return F.filter(found["links"], lambda m: (m["tail"] == "") & ~inside(m["s"], spans))


def detached_anchors(found: Column, spans: Column) -> Column:
    """From scan: uuid comments that follow no link, outside spans; gap: the blanks before them on their line."""
    attached = F.transform(F.filter(found["links"], lambda m: m["tail"] != ""), lambda m: m["e"] + F.char_length(m["attrs"]) + F.char_length(m["tail"]))
    strays = F.filter(found["comments"], lambda m: ~F.array_contains(attached, m["e"]) & ~inside(m["s"], spans))
    return F.transform(strays, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["line"].alias("line"), F.lower(m["uuid"]).alias("uuid"), m["gap"].alias("gap")))


def web_links(found: Column, spans: Column) -> Column:
    """From scan: links to the web, outside spans, with what may follow them."""
    return F.filter(found["web"], lambda m: F.lower(m["href"]).rlike(rf"^[{BLANK}]*https?://") & ~inside(m["s"], spans))


def robust_link(text: Column, href: Column, uuid: Column, attrs: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")"), attrs, F.lit(" <!-- uuid: "), uuid, F.lit(" -->"))


def web_anchor(text: Column, href: Column, uuid: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), href, F.lit(") <!-- web-uuid: "), uuid, F.lit(" -->"))
