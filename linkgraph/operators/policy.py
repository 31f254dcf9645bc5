"""A gate: which axes of a tree may fail a change, from a configuration, and the verdict."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from linkgraph.operators import check, documents, gate, robustify, web
from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut

#: Schemes and hosts of the remotes whose owners are told.
_SCHEMES, _HOST, _OTHER_HOSTS = ("http", "https", "ssh"), "github.com", ("www.github.com", "ssh.github.com")
_RUNGS = {"added_lines": "added-lines", "all": "repo", "on": "repo", "true": "repo", "yes": "repo", "1": "repo"}


@dataclass(frozen=True)
class GateConfig:
    """mode: repair, check or max; scope: repo or staged; dangling: off, warn, added-lines or repo.

    A budget that is no whole number counts as none (dangling_max: 0), so that a slip of the pen
    never widens what is allowed.
    """

    excludes: tuple[str, ...] = ()
    ignore_blocks: tuple[str, ...] = ()
    mode: str = "check"
    scope: str = "repo"
    fail_closed: bool = False
    web: bool = False
    own_web: tuple[str, ...] = ()
    own_web_from_origin: bool = False
    own_web_max: int | None = None
    create_readme: bool = False
    create_readme_excludes: tuple[str, ...] = ()
    dangling: str = "off"
    dangling_max: int = 0

    @classmethod
    def of(cls, values: dict) -> GateConfig:
        known = {f.name: values[f.name] for f in fields(cls) if f.name in values}
        for name in ("excludes", "ignore_blocks", "own_web", "create_readme_excludes"):
            if name in known:
                known[name] = tuple(known[name])
        for name, none in (("own_web_max", None), ("dangling_max", 0)):
            if name in known:
                known[name] = int(known[name]) if re.fullmatch("[0-9]+", str(known[name])) else none
        rung = str(known.get("dangling", "off")).lower()
        rung = _RUNGS.get(rung, rung)
        return cls(**known | {"dangling": rung if rung in ("warn", "added-lines", "repo") else "off"})

    @classmethod
    def read(cls, file: str) -> GateConfig:
        """The defaults if there is no such file; one that is no JSON object is an error."""
        if not os.path.exists(file):
            return cls()
        with open(file, encoding="utf-8-sig") as stream:
            values = json.load(stream)
        if not isinstance(values, dict):
            raise ValueError(f"{file} holds no object")
        return cls.of(values)

    def options(self, base: Options = Options()) -> Options:
        return replace(base, excludes=(*base.excludes, *self.excludes), ignore_blocks=(*base.ignore_blocks, *self.ignore_blocks))


def owner_of(url: str) -> str | None:
    """The owner in the address of a remote repository: scheme://host/owner/name, or user@host:owner/name."""
    url = url.strip()
    if "://" in url:
        try:
            parts = urlsplit(url)
            known = parts.scheme in _SCHEMES and parts.hostname in (_HOST, *_OTHER_HOSTS) and (parts.port is not None or not parts.netloc.endswith(":"))
        except ValueError:
            return None
        place = parts.path.removeprefix("/")
    else:
        server, _, place = url.partition(":")
        user, _, host = server.rpartition("@")
        known = host.lower() == _HOST and not set(user) & set("/@")
    owner, slash, _ = place.partition("/")
    return owner if known and url.isascii() and owner and slash else None


def origin_owner(root: str) -> str | None:
    """The owner of the remote named origin of the repository at root, whichever one a hook that runs this is about."""
    outer = [x for x in os.environ if x.startswith("GIT_")]
    try:
        url = subprocess.check_output(["env", *(f"--unset={x}" for x in outer), "git", "config", "remote.origin.url"], cwd=root, stderr=subprocess.DEVNULL, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return owner_of(url.decode("utf-8", "replace"))


@dataclass(frozen=True)
class Verdict:
    """code: 0 clean, 1 create-readme or dangling or what only mode max asks for, 2 broken, 3 loose, 4 web problems or a gate that must not be skipped and can't run. counts: by axis."""

    code: int
    counts: dict[str, int]
    notes: tuple[str, ...]


def skipped(config: GateConfig, why: str) -> Verdict:
    """What a gate says that can't judge: it lets the change pass, unless it is to fail closed."""
    return Verdict(4 if config.fail_closed else 0, {}, (f"not judged: {why}",))


def run(
    tree: Tree, config: GateConfig, staged: DataFrame | None = None, hunks: DataFrame | None = None, fetches: DataFrame | Callable[[DataFrame], DataFrame] | None = None, options: Options = Options(), root: str | None = None, have_token: bool = False
) -> Verdict:
    """staged (path) and hunks (path, start_line, n_lines) belong to the scope staged; fetches, or what makes them of web links, to the web axis.

    Mode max is more than check in the scope repo only; the web axis is a part of it, of clean trees.  root: the directory whose origin tells an
    owner, if the configuration asks for that.  Every pass only plans; only counts come to the driver.
    """
    if config.mode not in gate.MODES or config.scope not in ("repo", "staged"):
        raise ValueError("mode is one of repair, check, max; scope is repo or staged")
    if config.scope == "staged" and staged is None:
        return skipped(config, "the scope staged needs the staged files")
    owners = config.own_web
    if config.web and config.own_web_from_origin:
        own = origin_owner(root) if root else None
        if own is None:
            return skipped(config, "the owner of origin can't be told")
        owners = (*owners, own)
    options = config.options(options).seeded()
    narrowed = (lambda rows: gate.staged(rows, staged)) if config.scope == "staged" else lambda rows: rows
    found = check.check(tree, options)
    all_findings = cut(narrowed(found.findings))
    counts = {x.axis + ":" + x.kind: x["count"] for x in all_findings.groupBy("axis", "kind").count().collect()}
    of = lambda axis, kinds: sum(n for k, n in counts.items() if k.split(":")[0] == axis and k.split(":")[1] in kinds)
    broken, loose = of("integrity", check.BROKEN), of("strict", check.LOOSE)
    code = 2 if broken else 3 if loose and config.mode != "repair" else 0
    out, notes = {"broken": broken, "loose": loose}, []
    if config.mode == "max" and config.scope == "repo":
        more = robustify.plan(tree, replace(options, create_frontmatter=True)).findings
        out["max"] = narrowed(more).where("kind = 'robustify'").count()
        code = code or int(out["max"] > 0)
        if config.web and fetches is None:
            notes.append("web links are not judged: nothing fetches them")
            code = code or (4 if config.fail_closed else 0)
        elif config.web and not code:
            got = fetches(web.web_links(documents.prepared(tree, options, ("web",)))) if callable(fetches) else fetches
            verdict = web.check(tree, got, options, owners, have_token).verdict(config.own_web_max).first()
            out |= {"web_anchors": verdict.anchors, "web_problems": verdict.problems, "web_own": verdict.own}
            code = verdict.code
            if config.own_web_max is not None and verdict.own < config.own_web_max:
                notes.append(f"{verdict.own} owned files without a uuid are fewer than the budget of {config.own_web_max}; lower it")
    if config.create_readme:
        made = robustify.plan(tree, replace(options, create_readme=True, excludes=(*options.excludes, *config.create_readme_excludes)))
        out["create_readme"] = made.created.count()
        code = code or int(out["create_readme"] > 0)
    if config.dangling != "off":
        added = config.dangling == "added-lines" and config.scope == "staged"
        if added and hunks is None:
            return skipped(config, "the rung added-lines needs hunks")
        lost = gate.dangling(all_findings, "added-lines", hunks) if added else all_findings.where("kind = 'dangling'")
        out["dangling"] = n = lost.count()
        walled, most = added or config.dangling == "repo", config.dangling_max if config.dangling == "repo" else 0
        code = code or int(walled and n > most)
        if config.dangling == "repo" and n < most:
            notes.append(f"{n} dangling links are fewer than the budget of {most}; lower it")
    return Verdict(code, out, tuple(notes))
