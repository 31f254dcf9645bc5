"""Reports of the command line, as JSON or text; findings are streamed row by row and never all held at once.

The names of the reports' keys are fixed values: programs read them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Findings of each kind that a text shows of what can't be verified.
PREVIEW = 20
#: Findings that a text only counts: a tree may hold them by thousands without any being urgent.
COUNTED = ("dangling", "absolute_local_path")


@dataclass(frozen=True)
class Rows:
    """A list in a report: rows of one column, JSON or plain text, in the order of the frame."""

    frame: DataFrame
    is_json: bool = False

    def __iter__(self) -> Iterator[Any]:
        for row in self.frame.toLocalIterator():
            yield json.loads(row[0]) if self.is_json else row[0]


def write_json(value: Any, out: TextIO, indent: int = 0) -> None:
    """value as indented JSON; mappings may hold Rows, which are written as they arrive."""
    pad = " " * (indent + 2)
    if isinstance(value, Mapping):
        out.write("{")
        for k, (name, item) in enumerate(value.items()):
            out.write(f"{',' if k else ''}\n{pad}{json.dumps(name)}: ")
            write_json(item, out, indent + 2)
        out.write(f"\n{' ' * indent}}}" if value else "}")
    elif isinstance(value, Rows):
        out.write("[")
        some = False
        for item in value:
            out.write(f"{',' if some else ''}\n{pad}")
            write_json(item, out, indent + 2)
            some = True
        out.write(f"\n{' ' * indent}]" if some else "]")
    else:
        out.write(json.dumps(value))


def tolerant(*streams: TextIO) -> None:
    """Characters that a console can't show are escaped there, so that a report never fails on them."""
    for stream in streams or (sys.stdout, sys.stderr):
        if (reconfigure := getattr(stream, "reconfigure", None)) is not None:
            try:
                reconfigure(errors="backslashreplace")
            except (ValueError, OSError):
                continue


def file(root: str, path: Column | None = None) -> Column:
    """The whole path of a document under root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.col("path") if path is None else path)


def files(rows: DataFrame, root: str) -> Rows:
    return Rows(rows.select(file(root).alias("file")).orderBy("file"))


def listed(findings: DataFrame, root: str, *more: Column) -> Rows:
    """Findings by document and place: kind, file, detail and more."""
    found = findings.orderBy("path", "start", "kind").select(F.to_json(F.struct("kind", file(root).alias("file"), "detail", *more), {"ignoreNullFields": "false"}))
    return Rows(found, is_json=True)


def _scope(scope: DataFrame | None, root: str) -> Rows | None:
    return None if scope is None else files(scope.select("path"), root)


def plan_report(plan: Any, root: str, wrote: int, applied: bool, scope: DataFrame | None, invalid: DataFrame, outside: DataFrame) -> dict[str, Any]:
    """What repair or robustify would do or did."""
    return {
        "wrote": wrote, "applied": applied, "write_scope": _scope(scope, root),
        "suppressed_outside_write_scope": plan.suppressed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
        "ignored_files": files(plan.read.where("ignored"), root), "link_ignored_files": files(plan.read.where("link_ignored"), root),
        "invalid_frontmatter_files": files(invalid, root), "out_of_root_links": files(outside, root), "findings": listed(plan.findings, root),
    }


def check_report(found: Any, root: str, scope: DataFrame | None, outside: DataFrame) -> dict[str, Any]:
    """Both axes that decide the code, and those that are only told."""
    counts = {(x.axis, x.kind): x.n for x in found.counts().collect()}
    verdict, findings = found.verdict().first(), found.findings
    n = lambda axis, *kinds: sum(counts.get((axis, k), 0) for k in kinds)
    of = lambda axis, *kinds: findings.where((F.col("axis") == axis) & F.col("kind").isin(*kinds))
    invalid = {axis: {"invalid_frontmatter": n(axis, "invalid_frontmatter"), "invalid_frontmatter_files": files(of(axis, "invalid_frontmatter"), root)} for axis in ("integrity", "strict")}
    integrity = ("repair", "conflict", "unresolvable", "ambiguous", "invalid_frontmatter")
    return {
        "check": True, "exit_code": verdict.code, "write_scope": _scope(scope, root),
        "integrity": {"failed": verdict.broken > 0, "repairs": n("integrity", "repair"), "conflicts": n("integrity", "conflict"), "unresolved": n("integrity", "unresolvable", "ambiguous")} | invalid["integrity"] | {"findings": listed(of("integrity", *integrity), root)},
        "strict": {"failed": verdict.loose > 0, "robustify": n("strict", "robustify")} | invalid["strict"] | {"findings": listed(of("strict", "robustify", "invalid_frontmatter"), root)},
        "out_of_root_links": files(outside, root),
    } | {axis: {"count": n(axis, axis), "findings": listed(of(axis, axis), root, F.col("line"))} for axis in COUNTED}


def web_report(found: Any, root: str, code: int, wrote: int, applied: bool, own_max: int | None, outside: DataFrame) -> dict[str, Any]:
    """What web links were found to be, destinations having been fetched."""
    counts = {x.kind: x.n for x in found.findings.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kinds = ("web_ok", "web_anchor", "web_mismatch", "web_not_found", "web_unverifiable", "web_own_no_uuid", "web_own_exempt")
    row = F.struct("kind", file(root).alias("file"), "href", "detail", F.col("anchored").alias("anchored_uuid"))
    rows = Rows(found.findings.orderBy("path", "start").select(F.to_json(row, {"ignoreNullFields": "false"})), is_json=True)
    return {"web_check": True, "online": True, "exit_code": code, "wrote": wrote, "applied": applied} | {k: counts.get(k, 0) for k in kinds} | {"own_max": own_max, "out_of_root_links": files(outside, root), "findings": rows}


def web_listing(links: DataFrame, root: str, outside: DataFrame) -> dict[str, Any]:
    """The web links of a tree, nothing having been fetched."""
    row = F.struct(file(root).alias("file"), "href", F.col("uuid").isNotNull().alias("anchored"))
    return {"web_check": True, "online": False, "exit_code": 0, "web_links_seen": links.count(), "out_of_root_links": files(outside, root), "links": Rows(links.orderBy("path", "s").select(F.to_json(row)), is_json=True)}


def write_text(title: str, findings: DataFrame, outside: DataFrame, out: TextIO, notes: tuple[str, ...] = ()) -> None:
    """Counts of all kinds, then findings, one a line, but for those that are only counted; notes at the end."""
    out.write(f"{title}\n")
    for x in findings.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect():
        out.write(f"  {x.kind}: {x.n}\n")
    for path in Rows(outside.select("path").orderBy("path")):
        out.write(f"  [out_of_root] {path}: its target lies outside the root, so that it is no document\n")
    shown = findings.where(~F.col("kind").isin(*COUNTED, "web_ok"))
    hidden = shown.where("kind = 'web_unverifiable'").count() - PREVIEW
    for kind, rows in (("web_unverifiable", shown.where("kind = 'web_unverifiable'").orderBy("path", "start").limit(PREVIEW)), ("", shown.where("kind <> 'web_unverifiable'").orderBy("path", "start"))):
        for x in rows.select("path", F.coalesce("line", F.lit(1)).alias("line"), "kind", "href", "detail").toLocalIterator():
            out.write(f"  [{x.kind}] {x.path}:{x.line}: {x.href + ': ' if kind else ''}{x.detail}\n")
    if hidden > 0:
        out.write(f"  and {hidden} more that can't be verified\n")
    for note in notes:
        out.write(f"  {note}\n")
