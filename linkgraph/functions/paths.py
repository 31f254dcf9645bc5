"""Hrefs and paths as Column functions.

Paths are POSIX and relative to the root of the tree; the root itself is ``.``, and what lies
outside begins with ``..`` or ``/``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
ANCHOR_NAME = "README.md"
DEFAULT_EXCLUDES = (".git", "node_modules", ".venv", "__pycache__", "_build", ".tox", "dist", "build")
#: Every character that counts as white space, as the inside of a character class.
BLANK = r"\t\n\x0b\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def path_part(href: Column) -> Column:
    """What stands before the first #."""
    return F.substring_index(href, "#", 1)


def fragment(href: Column) -> Column:
    """What follows the first #; empty if there is none."""
    return F.regexp_extract(href, "(?s)^[^#]*#(.*)$", 1)


def is_web(href: Column) -> Column:
    return F.lower(stripped(href)).rlike("^https?://")


def is_local_relative(href: Column) -> Column:
    """A path, neither absolute nor with a scheme; not trimmed."""
    low = F.lower(path_part(href))
    return (low != "") & ~low.contains("://") & ~low.rlike("^(?:https?:|mailto:|ftp:|/)")


def is_local_md(href: Column) -> Column:
    return is_local_relative(href) & F.lower(path_part(href)).endswith(".md")


def is_absolute_local(href: Column) -> Column:
    """Begins with one slash, not two."""
    return path_part(href).rlike("^/(?!/)")


def names_md(href: Column) -> Column:
    """Whether the href is of a file rather than a directory."""
    return F.lower(stripped(path_part(href))).endswith(".md")


def percent_decoded(text: Column) -> Column:
    """Of valid escapes only; + stays, and bytes that are no UTF-8 become U+FFFD."""
    escaped = F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(escaped)).otherwise(text)


def normalised(path: Column) -> Column:
    """Without empty parts and ``.``, and with ``..`` resolved as far as the text goes."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when((part == "") | (part == "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    absolute = path.startswith("/")
    joined = F.when(absolute, F.concat(F.lit("/"), F.regexp_replace(joined, r"^(?:\.\./?)+", ""))).otherwise(joined)
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def parent(path: Column) -> Column:
    """Of a normalised path; ``.`` for what stands in the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolved(href: Column, path: Column) -> Column:
    """The path that the href of a document at path names; neither decoded nor trimmed."""
    part = path_part(href)
    return normalised(F.when(part.startswith("/"), part).otherwise(F.concat(parent(path), F.lit("/"), part)))


def relative(target: Column, start: Column) -> Column:
    """target as seen from the directory start, both normalised."""
    split = lambda p: F.when(p == ".", F.array().cast("array<string>")).otherwise(F.split(p, "/"))
    a, b = split(start), split(target)
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.element_at(a, i) != F.element_at(b, i))
    common = F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)
    out = F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.size(b) - common))
    return F.when(F.size(out) == 0, F.lit(".")).otherwise(F.array_join(out, "/"))


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole of a name: ``*``, ``?`` and ``[...]``, where ``!`` negates."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + inside[1:] if inside[0] == '!' else inside}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches_any(name: Column, globs: tuple[str, ...]) -> Column:
    """Case-sensitive, whole names."""
    out = F.lit(False)
    for glob in globs:
        out = out | name.rlike(glob_pattern(glob))
    return out


def within_excluded(directory: Column, excludes: tuple[str, ...]) -> Column:
    return F.exists(F.split(directory, "/"), lambda part: matches_any(part, excludes))
