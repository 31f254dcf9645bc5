"""Command line: ``python -m linkgraph.cli [check | web-check | gate] ROOT [options]``; without a command, repair or robustify."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import lit

from linkgraph.operators import check, documents, policy, repair, report, robustify, web
from linkgraph.operators.documents import Options, Tree
from linkgraph.sources import git
from linkgraph.sources import tree as trees

COMMANDS = ("check", "web-check", "gate")


class WrongCall(Exception):
    """Of a command that can't be run as it was called."""

    def __init__(self, message: str, code: int = 1) -> None:
        super().__init__(message)
        self.code = code


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise WrongCall(message)


def parser(command: str) -> argparse.ArgumentParser:
    """The names of options are fixed values; each command takes only its own."""
    out = _Parser(prog=f"linkgraph {command}".strip(), description=__doc__, exit_on_error=False)
    many = {"action": "append", "default": []}
    out.add_argument("root", nargs="?", default=".")
    out.add_argument("--exclude", metavar="GLOB", **many)
    out.add_argument("--ignore-block", metavar="NAME", **many)
    out.add_argument("--marker-prefix", default="linkgraph")
    out.add_argument("--json", action="store_true")
    if command in ("", "check"):
        out.add_argument("--only", metavar="PATH", help="a document whose links are judged; the whole tree is read", **many)
        out.add_argument("--only-from", metavar="FILE", help="paths, one a line; - for standard input")
    if command in ("", "web-check"):
        out.add_argument("--write", action="store_true", help="write what is planned; without it nothing is written")
    if command == "":
        out.add_argument("--robustify", action="store_true", help="anchor plain links instead of repairing robust ones")
        out.add_argument("--create-frontmatter", action="store_true")
        out.add_argument("--create-readme", action="store_true")
        out.add_argument("--no-create-frontmatter-for", metavar="GLOB", **many)
        out.add_argument("--no-target-writes", action="store_true")
    if command == "web-check":
        out.add_argument("--online", action="store_true", help="fetch the destinations")
        out.add_argument("--own", metavar="OWNER", **many)
        out.add_argument("--own-from-origin", action="store_true")
        out.add_argument("--own-max", type=int, metavar="N")
    if command == "gate":
        out.add_argument("--config", metavar="FILE", help="its configuration, as JSON")
    return out


def _scope(spark: SparkSession, args: argparse.Namespace, root: str, tree: Tree) -> DataFrame | None:
    named = list(args.only)
    if args.only_from:
        try:
            lines = sys.stdin.read() if args.only_from == "-" else open(args.only_from, encoding="utf-8").read()
        except OSError as error:
            raise WrongCall(f"--only-from: {error}") from error
        named += [x.strip() for x in lines.splitlines() if x.strip()]
    if getattr(args, "no_target_writes", False) and not named:
        raise WrongCall("--no-target-writes needs --only or --only-from")
    if not named:
        return None
    try:
        return trees.scope_of(spark.createDataFrame([(trees.under(x, root),) for x in named], "path string"), tree.entries)
    except ValueError as error:
        raise WrongCall(str(error)) from error


def _owners(args: argparse.Namespace, root: str) -> tuple[str, ...]:
    owners = [x.strip() for x in args.own if x.strip()]
    asked = args.own or args.own_from_origin or args.own_max is not None
    if not args.online and (args.write or asked):
        raise WrongCall("--write and --own need --online: destinations decide")
    if args.own and not owners:
        raise WrongCall("--own needs a name")
    if args.own_max is not None and args.own_max < 0:
        raise WrongCall("--own-max is 0 or more")
    if args.own_from_origin:
        origin = policy.origin_owner(root)
        if origin is None:
            raise WrongCall("the owner of origin can't be told")
        owners.append(origin)
    if args.own_max is not None and not owners:
        raise WrongCall("--own-max needs owners")
    return tuple(owners)


def _links(tree: Tree, options: Options, args: argparse.Namespace, root: str, scope: DataFrame | None) -> int:
    plan = (robustify if args.robustify else repair).plan(tree, options, scope)
    if args.robustify:
        invalid = plan.decisions.where("outcome = 'invalid_frontmatter'").selectExpr("target AS path")
        bad = invalid
    else:
        invalid = documents.invalid_documents(plan.read)
        bad = invalid.unionByName(plan.findings.where("kind IN ('conflict', 'unresolvable', 'ambiguous')").select("path"))
    pending = plan.rewrites()
    failed, waiting = bool(bad.limit(1).count()), not args.write and bool(pending.limit(1).count())
    # What is written is known to the report; the report's findings don't depend on the files any more.
    wrote = trees.write(pending, root) if args.write else 0
    outside = tree.outside
    if args.json:
        report.write_json(report.plan_report(plan, root, wrote, args.write, scope, invalid, outside), sys.stdout)
        print()
    else:
        suppressed = plan.suppressed.agg({"n": "sum"}).first()[0] or 0
        notes = (f"{wrote} files written" if args.write else "nothing is written without --write",) + ((f"{suppressed} findings outside the scope are neither listed nor written",) if suppressed else ())
        found = plan.findings.unionByName(documents.findings(invalid, "integrity", "invalid_frontmatter", lit(documents.INVALID))) if not args.robustify else plan.findings
        report.write_text(f"linkgraph {'robustify' if args.robustify else 'repair'}: {root}", found, outside, sys.stdout, notes)
    return int(failed or waiting)


def _check(tree: Tree, options: Options, args: argparse.Namespace, root: str, scope: DataFrame | None) -> int:
    found = check.check(tree, options, scope)
    code = found.verdict().first().code
    if args.json:
        report.write_json(report.check_report(found, root, scope, tree.outside), sys.stdout)
        print()
    else:
        report.write_text(f"linkgraph check: {root}", found.findings, tree.outside, sys.stdout, (f"exit {code}",))
    return code


def _web_check(tree: Tree, options: Options, args: argparse.Namespace, root: str, fetch: Callable[..., tuple[int, str | None]]) -> int:
    owners, token = _owners(args, root), os.environ.get(web.TOKEN_VARIABLE) or None
    links = web.web_links(documents.prepared(tree, options, ("web",)))
    if not args.online:
        if args.json:
            report.write_json(report.web_listing(links, root, tree.outside), sys.stdout)
            print()
        else:
            print(f"linkgraph web-check: {root}\n  web links seen: {links.count()}")
            for x in links.orderBy("path", "s").toLocalIterator():
                print(f"  [{'anchored' if x.uuid else 'plain'}] {x.path}: {x.href}")
        return 0
    found = web.check(tree, web.fetched(links, token, once=fetch), options, owners, have_token=token is not None)
    verdict = found.verdict(args.own_max).first()
    wrote = trees.write(found.rewrites(), root) if args.write else 0
    code = 0 if args.write and verdict.code == 3 else verdict.code
    if args.json:
        report.write_json(report.web_report(found, root, code, wrote, args.write, args.own_max, tree.outside), sys.stdout)
        print()
    else:
        unseen, helped = (found.findings.where(x).count() for x in ("kind = 'web_unverifiable'", "kind = 'web_unverifiable' AND token_would_help"))
        notes = [f"{unseen} links can't be verified" + (f", {helped} of them for want of {web.TOKEN_VARIABLE}" if helped else "")] if unseen else []
        if args.own_max is not None:
            notes.append(f"{verdict.own} owned files without a uuid, budget {args.own_max}" + ("; lower it" if verdict.own < args.own_max else ""))
        report.write_text(f"linkgraph web-check: {root}", found.findings, tree.outside, sys.stdout, (*notes, f"exit {code}"))
    return code


def _gate(spark: SparkSession, tree: Tree, options: Options, args: argparse.Namespace, root: str, fetch: Callable[..., tuple[int, str | None]]) -> int:
    try:
        config = policy.GateConfig.read(args.config) if args.config else policy.GateConfig()
        token, staged, hunks = os.environ.get(web.TOKEN_VARIABLE) or None, None, None
        if config.scope == "staged":
            staged, hunks = git.staged(spark, root), git.staged_hunks(spark, root) if config.dangling == "added-lines" else None
        verdict = policy.run(tree, config, staged, hunks, lambda links: web.fetched(links, token, once=fetch), options, root, token is not None)
    except ValueError as error:
        raise WrongCall(str(error)) from error
    report.write_json({"exit_code": verdict.code, "counts": verdict.counts, "notes": list(verdict.notes)}, sys.stdout)
    print()
    return verdict.code


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, fetch: Callable[..., tuple[int, str | None]] = web.fetch_once) -> int:
    """0: nothing to do; 1: findings or a wrong call; check: 2 broken, 3 loose; web-check: 3 anchors pending, 4 problems; gate: as policy.Verdict."""
    report.tolerant()
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in COMMANDS else ""
    try:
        args = parser(command).parse_args(argv)
        if not os.path.isdir(args.root):
            raise WrongCall(f"{args.root} is no directory", 1 if command else 2)
        if command == "web-check":
            _owners(args, args.root)
        root = os.path.realpath(args.root)
        spark = spark or SparkSession.builder.appName("linkgraph").getOrCreate()
        named = {} if command else {"deny_globs": tuple(args.no_create_frontmatter_for), "create_frontmatter": args.create_frontmatter, "create_readme": args.create_readme, "allow_target_writes": not args.no_target_writes}
        options = Options(excludes=tuple(args.exclude), ignore_blocks=tuple(args.ignore_block), marker_prefix=args.marker_prefix, root_name=os.path.basename(root), **named)
        tree = trees.tree(spark, root, options)
        if command == "web-check":
            return _web_check(tree, options, args, root, fetch)
        if command == "gate":
            return _gate(spark, tree, options, args, root, fetch)
        return (_check if command else _links)(tree, options, args, root, _scope(spark, args, root, tree))
    except (WrongCall, argparse.ArgumentError) as error:
        print(f"linkgraph: {error}", file=sys.stderr)
        return getattr(error, "code", 1)


if __name__ == "__main__":
    sys.exit(main())
