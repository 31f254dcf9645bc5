"""Repair, robustify, check, web and gate on small trees."""

from __future__ import annotations

import json

import pytest

from linkgraph.operators import check, documents, gate, repair, robustify, web
from linkgraph.operators.documents import Options, Tree
from linkgraph.sources import git as trees_git
from linkgraph.sources import tree as trees

U, V, W = "11111111-1111-1111-1111-11111111111a", "2222222b-1111-1111-1111-111111111111", "33333333-cccc-1111-1111-111111111111"
DOC = f"---\nuuid: {U}\n---\n\n# B\n"


def a(uuid):
    return f" <!-- uuid: {uuid} -->"


def tree_of(spark, docs, more=()):
    extra = spark.createDataFrame(list(more), "path string, type string") if more else None
    return Tree.of(spark.createDataFrame(list(docs.items()), "path string, content string"), extra)


def kinds(findings):
    return sorted((x.path, x.kind, x.href) for x in findings.collect())


def rewritten(plan):
    return {x.path: x.new_content for x in plan.rewrites().collect()}


def test_moved_target_is_repaired_once(spark):
    docs = {"new/B.md": DOC, "i.md": f"[B](old/B.md){a(U)} é [B](old/B.md#sec){{.c}}  {a(U.upper())}", "x/y/d.md": f"[B](../../old/B.md){a(U)}"}
    out = rewritten(repair.plan(tree_of(spark, docs)))
    assert out == {"i.md": f"[B](new/B.md){a(U)} é [B](new/B.md#sec){{.c}}{a(U)}", "x/y/d.md": f"[B](../../new/B.md){a(U)}"}
    assert rewritten(repair.plan(tree_of(spark, docs | out))) == {}


def test_repair_verdicts(spark):
    docs = {
        "B.md": DOC, "e.md": "# no", "d1.md": f"---\nuuid: {V}\n---\n", "d2.md": f"---\nuuid: {V.upper()}\n---\n", "r/README.md": f"---\nuuid: {W}\n---\n",
        "s.md": f"[a](e.md){a(U)} [b](B.md ){a(U)} [c](x.md){a(V)} [d](x.md){a('9' * 36)} [e](q/){a(U)} [f](old/){a(W)} [g](./r){a(W)} [h](https://x/y.md){a(U)} [i](r){a(U)}",
        "opt.md": f"<!-- linkgraph-ignore-links --> [a](x.md){a(U)}", "out.md": f"<!-- linkgraph-ignore-file -->[a](x.md){a(U)}", "code.md": f"`<!-- linkgraph-ignore-file -->` [a](x.md){a(U)}",
    }
    found = kinds(repair.plan(tree_of(spark, docs)).findings)
    assert found == sorted([("s.md", "conflict", "e.md"), ("s.md", "repair", "B.md "), ("s.md", "ambiguous", "x.md"), ("s.md", "unresolvable", "x.md"), ("s.md", "conflict", "q/"), ("s.md", "repair", "old/"), ("s.md", "conflict", "r"), ("code.md", "repair", "x.md"), ("opt.md", "ignored_links", None)], key=lambda x: (x[0], x[1], x[2] or ""))


def test_robustify_outcomes_and_rewrites(spark):
    docs = {
        "B.md": DOC, "fm.md": "---\r\ntitle: x\r\n---\r\n", "no.md": "# no", "bad.md": "---\nuuid: [a\n---\n", "ign.md": "<!-- linkgraph-ignore-file -->", "deny.md": "---\nt: x\n---\n", "r/README.md": f"---\nuuid: {W}\n---\n", "e/x.md": "x",
        "s.md": '[b](B.md){k="a}b"} [f](fm.md) [n](no.md) [x](bad.md) [i](ign.md) [d](deny.md) [r](r#s) [e](e/) [m](gone.csv) [p](a%20b.md) [q](%2Fetc/x) [z](/abs) [me](s.md) [w](http://x) [o](../o.md) `[c](c.md)`',
    }
    options = Options(deny_globs=("deny*",))
    plan = robustify.plan(tree_of(spark, docs, [("../o.md", "file")]), options)
    assert kinds(plan.findings) == sorted([("s.md", "robustify", "B.md"), ("s.md", "robustify", "fm.md"), ("s.md", "no_frontmatter", "no.md"), ("bad.md", "invalid_frontmatter", None), ("s.md", "deny_listed", "deny.md"), ("s.md", "robustify", "r#s"), ("s.md", "dangling", "gone.csv"), ("s.md", "dangling", "a%20b.md"), ("s.md", "absolute_local_path", "%2Fetc/x"), ("s.md", "absolute_local_path", "/abs"), ("s.md", "out_of_scope", "../o.md")], key=lambda x: (x[0], x[1], x[2] or ""))
    out = rewritten(plan)
    new = out["fm.md"].split("uuid: ")[1][:36]
    assert out["fm.md"] == f"---\r\nuuid: {new}\r\ntitle: x\r\n---\r\n"
    assert out["s.md"].startswith(f'[b](B.md){{k="a}}b"}}{a(U)} [f](fm.md){a(new)} [n](no.md) [x]') and f"[r](r#s){a(W)} [e](e/)" in out["s.md"]
    again = robustify.plan(tree_of(spark, docs | out, [("../o.md", "file")]), options)
    assert rewritten(again) == {}


def test_stray_anchors(spark):
    docs = {"B.md": DOC, "s.md": f"**[b](B.md)**{a(U)} end\n[b](B.md) x{a(U)} y{a(U)}\n{a(U)} [b](B.md)\n[b](B.md) [c](B.md) z{a(U)}\n"}
    out = rewritten(robustify.plan(tree_of(spark, docs)))["s.md"].split("\n")
    assert out[0] == f"**[b](B.md){a(U)}** end"
    assert out[1] == f"[b](B.md){a(U)} x{a(U)} y{a(U)}"
    assert out[2] == f"{a(U)} [b](B.md){a(U)}"
    assert out[3] == f"[b](B.md){a(U)} [c](B.md){a(U)} z{a(U)}"


def test_created_readmes(spark):
    docs = {"d/x.md": "x", "ext/y.md": "<!-- linkgraph-ignore-file -->", "build/z.md": "z", "s.md": "[d](d) [d](d/) [e](ext/) [b](build/) [u](..)"}
    plan = robustify.plan(tree_of(spark, docs), Options(create_readme=True))
    out = rewritten(plan)
    new = out["d/README.md"].split("uuid: ")[1][:36]
    assert out == {"d/README.md": f"---\nuuid: {new}\n---\n\n# d\n", "s.md": f"[d](d){a(new)} [d](d/){a(new)} [e](ext/) [b](build/) [u](..)"}


def test_write_scope(spark):
    docs = {"B.md": DOC, "fm.md": "---\nt: x\n---\n", "one.md": f"[b](old/B.md){a(U)} [f](fm.md) [b](B.md)", "two.md": f"[b](old/B.md){a(U)} [f](fm.md) [b](B.md)"}
    tree, scope = tree_of(spark, docs), spark.createDataFrame([("one.md",)], "path string")
    plan = repair.plan(tree, Options(), scope)
    assert set(rewritten(plan)) == {"one.md"} and [tuple(x) for x in plan.suppressed.collect()] == [("two.md", 1)]
    plan = robustify.plan(tree, Options(), scope)
    assert set(rewritten(plan)) == {"one.md", "fm.md"} and ("fm.md", "target_uuid_write", None) in kinds(plan.findings)
    assert [tuple(x) for x in plan.suppressed.collect()] == [("two.md", 1)]
    plan = robustify.plan(tree, Options(allow_target_writes=False), scope)
    assert set(rewritten(plan)) == {"one.md"} and ("one.md", "target_write_refused", "fm.md") in kinds(plan.findings)


def test_check_codes(spark):
    clean, broken, loose = {"B.md": DOC, "s.md": f"[b](B.md){a(U)}"}, {"B.md": DOC, "s.md": f"[b](C.md){a(U)}"}, {"B.md": DOC, "s.md": "[b](B.md)"}
    assert [check.check(tree_of(spark, x)).verdict().first().code for x in (clean, broken, loose, broken | {"t.md": "[b](B.md)"})] == [0, 2, 3, 2]
    assert check.check(tree_of(spark, {"s.md": ""})).report().collect() == []


def test_web_verdicts(spark):
    link = "https://github.com/Own/r/blob/main/"
    fm = f"---\nuuid: {U}\n---\n"
    text = "\n".join([f"[a]({link}a.md) <!-- web-uuid: {U} -->", f"[b]({link}b.md) <!-- web-uuid: {V} -->", f"[c]({link}c.md){{.x}}", f"[d]({link}d.md)", f"[e]({link}e.md)", "[f](https://other.org/x.md)", f"[g]({link}d.md) <!-- linkgraph-own-exempt -->", "[h](https://github.com/own/r/blob/abcdef0/d.md)", f"[i]({link}i.md)"])
    rows = [(f"{link}a.md", 200, fm), (f"{link}b.md", 200, fm), (f"{link}c.md", 200, fm), (f"{link}d.md", 200, "x"), (f"{link}e.md", 404, None), ("https://github.com/own/r/blob/abcdef0/d.md", 200, "x"), (f"{link}i.md", 200, "---\nuuid: [\n---\n")]
    fetches = spark.createDataFrame(rows, "href string, status int, body string")
    found = web.check(tree_of(spark, {"s.md": text}), fetches, Options(), owners=("own",))
    assert [x.kind for x in found.findings.orderBy("start").collect()] == ["web_ok", "web_mismatch", "web_anchor", "web_own_no_uuid", "web_unverifiable", "web_unverifiable", "web_own_exempt", "web_unverifiable", "web_unverifiable"]
    assert found.verdict().first().code == 4
    assert f"[c]({link}c.md) <!-- web-uuid: {U} -->{{.x}}" in rewritten(found)["s.md"]
    got = web.fetched(web.web_links(documents.prepared(tree_of(spark, {"s.md": text}), Options())), once=lambda *x: (200, x[0]))
    assert {x.href: x.body for x in got.collect()}[f"{link}a.md"] == "https://api.github.com/repos/Own/r/contents/a.md?ref=main"
    calls, waits = [], []
    assert web.with_retries(lambda: (calls.append(1), (503, None))[1], 3, waits.append) == (503, None) and len(calls) == 3 and waits == [0.5, 1.0]


def test_gate(spark):
    findings = robustify.plan(tree_of(spark, {"s.md": "[a](x.md)\n[b](y.md)\n"})).findings
    diff = spark.createDataFrame([("s.md", "@@ -1,0 +2 @@ x"), ("s.md", "@@ -5,2 +1,0 @@")], "path string, header string")
    assert [x.href for x in gate.dangling(findings, "added-lines", gate.hunks_of(diff)).collect()] == ["y.md"]
    assert gate.within_budget(gate.dangling(findings, "repo"), 1).first().passes is False and gate.dangling(findings, "warn").count() == 0
    with pytest.raises(ValueError, match="rung"):
        gate.dangling(findings, "x")
    assert gate.staged(findings, spark.createDataFrame([("t.md",)], "path string")).count() == 0 and gate.by_mode(findings, "repair").count() == 0


def test_directory_tree(spark, tmp_path):
    for name, data in {"B.md": DOC.encode(), "_x/.h.MD": b"\xef\xbb\xbf[b](../old/B.md)" + a(U).encode() + b"\r\n", "node_modules/n.md": b"x", "empty.md": b"", "bad.md": b"\xff", "pic.png": b"p"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.md").symlink_to(tmp_path / "B.md")
    (tmp_path / "out.md").symlink_to("/etc/hostname")
    tree = trees.tree(spark, str(tmp_path))
    assert sorted(x.path for x in tree.docs.collect()) == ["B.md", "_x/.h.MD", "bad.md", "empty.md"]
    assert [x.path for x in trees.out_of_root(trees.scanned(spark, str(tmp_path))).collect()] == ["out.md"]
    plan = repair.plan(tree)
    assert trees.write(plan.rewrites(), str(tmp_path)) == 1
    assert (tmp_path / "_x/.h.MD").read_bytes() == b"\xef\xbb\xbf[b](../B.md)" + a(U).encode() + b"\r\n"
    scope = spark.createDataFrame([("B.md",), ("pic.png",)], "path string")
    with pytest.raises(ValueError, match="pic.png"):
        trees.scope_of(scope, tree.entries)


def test_empty_tree(spark):
    tree = Tree.of(spark.createDataFrame([], "path string, content string"))
    found = check.check(tree)
    assert found.findings.count() == 0 and found.verdict().first().code == 0 and found.repair.rewrites().count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "B.md").write_text(DOC)
    (tmp_path / "s.md").write_text(f"[b](old/B.md){a(U)}")
    from linkgraph.cli import main

    assert main(["check", str(tmp_path), "--json"], spark) == 2 and '"kind": "repair"' in capsys.readouterr().out
    assert main([str(tmp_path)], spark) == 1 and main([str(tmp_path), "--write"], spark) == 0
    assert (tmp_path / "s.md").read_text() == f"[b](B.md){a(U)}"
    assert main(["check", str(tmp_path)], spark) == 0 and main(["check", str(tmp_path), "--write"], spark) == 1
    assert main([str(tmp_path), "--only", "none.md"], spark) == 1
    capsys.readouterr()
    # Absolute paths name the scope; a root that is none, and options that don't go together, are wrong calls.
    (tmp_path / "t.md").write_text(f"[b](old/B.md){a(U)}")
    (tmp_path / "bad.md").write_text("---\nuuid: [\n---\n")
    assert main([str(tmp_path), "--only", str(tmp_path / "s.md"), "--json"], spark) == 1
    found = json.loads(capsys.readouterr().out)
    assert found["write_scope"] == [str(tmp_path / "s.md")] and found["suppressed_outside_write_scope"] == 1 and found["invalid_frontmatter_files"] == [str(tmp_path / "bad.md")] and found["findings"] == [] and found["applied"] is False
    assert main([str(tmp_path / "none")], spark) == 2 and main(["check", str(tmp_path / "none")], spark) == 1 and main([str(tmp_path), "--no-target-writes"], spark) == 1 and main(["gate", "--write"], spark) == 1 and main(["check", "--nonsense"], spark) == 1
    assert main(["web-check", str(tmp_path), "--own", "x"], spark) == 1 and main(["web-check", str(tmp_path), "--online", "--own-max", "3"], spark) == 1 and main(["web-check", str(tmp_path), "--online", "--own", " "], spark) == 1


def test_report_shapes(spark, tmp_path, capsys):
    from linkgraph.cli import main

    link = "https://github.com/Own/r/blob/main/"
    (tmp_path / "s.md").write_text(f"[b](B.md) [m](gone.md) [z](/srv/x) [w]({link}a.md)\n[v]({link}b%20c.md) <!-- web-uuid: {V} -->\n[u](https://x.org/y)")
    (tmp_path / "B.md").write_text(DOC)
    (tmp_path / "out.md").symlink_to("/etc/hostname")
    assert main(["check", str(tmp_path), "--json"], spark) == 3
    found = json.loads(capsys.readouterr().out)
    assert list(found) == ["check", "exit_code", "write_scope", "integrity", "strict", "out_of_root_links", "dangling", "absolute_local_path"]
    assert found["integrity"] == {"failed": False, "repairs": 0, "conflicts": 0, "unresolved": 0, "invalid_frontmatter": 0, "invalid_frontmatter_files": [], "findings": []}
    assert found["strict"]["failed"] and found["strict"]["robustify"] == 1 and [(x["kind"], x["file"]) for x in found["strict"]["findings"]] == [("robustify", str(tmp_path / "s.md"))]
    assert found["out_of_root_links"] == [str(tmp_path / "out.md")] and found["dangling"]["count"] == 1 and found["dangling"]["findings"][0]["line"] == 1 and found["absolute_local_path"]["count"] == 1
    assert main(["check", str(tmp_path)], spark) == 3 and "out.md" in capsys.readouterr().out
    assert main(["web-check", str(tmp_path), "--json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["web_links_seen"] == 3 and [x["anchored"] for x in found["links"]] == [False, True, False] and found["online"] is False
    answers = {"a.md": (200, DOC), "b%20c.md": (200, "x")}
    fetch = lambda address, token: answers[address.split("/contents/")[1].split("?")[0]]
    assert main(["web-check", str(tmp_path), "--online", "--json"], spark, fetch) == 4
    found = json.loads(capsys.readouterr().out)
    assert (found["web_anchor"], found["web_mismatch"], found["web_unverifiable"], found["own_max"]) == (1, 1, 1, None) and [x["anchored_uuid"] for x in found["findings"]] == [U, None, None]
    assert main(["web-check", str(tmp_path), "--online", "--write"], spark, fetch) == 4 and f"a.md) <!-- web-uuid: {U} -->" in (tmp_path / "s.md").read_text()


def test_gate_of_a_repository(spark, tmp_path, capsys):
    import subprocess

    from linkgraph.cli import main

    git = lambda *x: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *x], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "old.md").write_text("[m](gone.md)\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    config = tmp_path / "gate.json"
    config.write_text('{"scope": "staged", "dangling": "added-lines"}')
    gated = lambda: (main(["gate", str(tmp_path), "--config", str(config)], spark), capsys.readouterr())[0]
    (tmp_path / "old.md").write_text("[m](gone.md)\nmore\n")
    git("add", "-A")
    assert gated() == 0
    (tmp_path / "old.md").write_text("[m](gone.md)\nmore [n](lost.md)\n")
    git("add", "-A")
    assert gated() == 1
    config.write_text('{"mode": "max", "web": true, "own_web_from_origin": true, "fail_closed": true}')
    assert gated() == 4  # no origin
    config.write_text('{"mode": "max", "web": true, "own_web_from_origin": true}')
    assert gated() == 0
    git("remote", "add", "origin", "git@github.com:Own/r.git")
    from linkgraph.operators.policy import origin_owner

    assert origin_owner(str(tmp_path)) == "Own" and origin_owner("/") is None
    with pytest.raises(ValueError, match="staged"):
        trees_git.staged(spark, "/")


def test_fetching():
    import http.client
    import urllib.error

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return b"\xef\xbb\xbfa\xff"

    seen = []

    def opener(request, timeout):
        seen.append((request.full_url, timeout, dict(request.header_items())))
        return Answer()

    assert web.fetch_once("https://api.github.com/x", "t", opener=opener) == (200, "a\ufffd")
    assert seen[0][1] == 15 and seen[0][2]["Authorization"] == "Bearer t" and seen[0][2]["Accept"] == "application/vnd.github.raw" and seen[0][2]["User-agent"]

    def failing(error):
        def opener(request, timeout):
            raise error

        return web.fetch_once("https://api.github.com/x", opener=opener)

    cases = {http.client.IncompleteRead(b""): -1, http.client.BadStatusLine("x"): -1, http.client.InvalidURL("x"): -3, UnicodeEncodeError("ascii", "é", 0, 1, "x"): -3, OSError(): -1, TimeoutError(): -1, urllib.error.HTTPError("u", 403, "m", {}, None): 403}
    assert [failing(x)[0] for x in cases] == list(cases.values())
    assert web.fetch_once("no scheme") == (-3, None)
    assert [web.attempts_of({web.ATTEMPTS_VARIABLE: x}) for x in ("5", "0", "-2", "x", "")] == [5, 1, 1, 3, 3] and web.attempts_of({}) == 3


def test_repositories_are_asked_for_once(spark, tmp_path):
    link = "https://github.com/Own/%s/blob/main/%s.md"
    text = "\n".join(f"[a]({link % x})" for x in (("open", "a"), ("open", "b"), ("closed", "a"), ("closed", "b")))
    log = tmp_path / "log"

    def once(address, token, log=str(log)):
        with open(log, "a") as out:
            out.write(address + "\n")
        return (404, None) if "/contents/" in address or address.endswith("closed") else (200, "x")

    got = web.fetched(web.web_links(documents.prepared(tree_of(spark, {"s.md": text, "t.md": text}), Options())), "token", 1, once)
    assert sorted((x.href.split("/")[4], x.status) for x in got.collect()) == [("closed", -2)] * 2 + [("open", 404)] * 2
    assert len(log.read_text().split()) == 6
    assert {x.status for x in web.fetched(web.web_links(documents.prepared(tree_of(spark, {"s.md": text}), Options())), None, 1, once).collect()} == {404}


def test_every_plan_gives_out_its_own_uuids(spark):
    tree = tree_of(spark, {"fm.md": "---\nt: x\n---\n", "s.md": "[f](fm.md)"})
    one, two = (robustify.plan(tree) for _ in range(2))
    new = lambda plan: rewritten(plan)["fm.md"].split("uuid: ")[1][:36]
    assert new(one) == new(one) and new(one) in rewritten(one)["s.md"] and new(one) != new(two)
    assert new(robustify.plan(tree, Options(mint_seed="x"))) == new(robustify.plan(tree, Options(mint_seed="x")))


def test_no_readme_beside_foreign_documents(spark):
    rows = [("d/x.md", None), ("e/y.md", "y"), ("s.md", "[d](d/) [e](e/)")]
    plan = robustify.plan(Tree.of(spark.createDataFrame(rows, "path string, content string")), Options(create_readme=True))
    assert [x.path for x in plan.created.collect()] == ["e/README.md"]


def test_modes_keep_repeated_findings(spark):
    tree = tree_of(spark, {"no.md": "# no", "B.md": DOC, "s.md": "[n](no.md) [n](no.md) [b](B.md) [b](B.md)"})
    one, two = robustify.plan(tree).findings, robustify.plan(tree, Options(create_frontmatter=True)).findings
    assert sorted(x.kind for x in gate.by_mode(one, "max", two).collect()) == ["no_frontmatter"] * 2 + ["robustify"] * 4


def test_streaming_gate(spark, tmp_path):
    from linkgraph.streaming.gate import gated

    base = {"B.md": DOC, "s.md": "[b](B.md)"}
    spark.createDataFrame([("s.md", "[m](gone.md)")], "path string, content string").write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    taken = []
    query = gated(changes, lambda: tree_of(spark, base), lambda found, n: taken.append(kinds(found.findings))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert taken == [[("s.md", "dangling", "gone.md")]]


def test_gate_policy(spark, tmp_path):
    from linkgraph.operators.policy import GateConfig, owner_of, run

    assert [owner_of(x) for x in ("https://github.com/Own/r.git", "git@github.com:own/r", "ssh://git@ssh.github.com:443/o/r", "https://other.org/a/b", "HTTPS://u:p@WWW.GitHub.com/o/r\n", "github.com:o/r", "https://g\u0131thub.com/o/r", "https://github.com/o", "ftp://github.com/o/r", "https://github.com//o/r", "")] == ["Own", "own", "o", None, "o", "o", None, None, None, None, None]
    file = tmp_path / "gate.json"
    file.write_text('﻿{"mode": "max", "dangling": "on", "dangling_max": "two", "excludes": ["x"], "other": 1}', encoding="utf-8")
    config = GateConfig.read(str(file))
    assert (config.mode, config.dangling, config.dangling_max, config.excludes) == ("max", "repo", 0, ("x",)) and GateConfig.read("none.json") == GateConfig()
    clean, lost = {"B.md": DOC, "s.md": f"[b](B.md){a(U)}"}, {"B.md": DOC, "s.md": f"[b](B.md){a(U)} [m](gone.md)", "d/x.md": "x"}
    assert run(tree_of(spark, clean), config).code == 0
    tree = tree_of(spark, lost)
    assert run(tree, config).code == 1 and run(tree, GateConfig(dangling="repo", dangling_max=2)).notes and run(tree, GateConfig(dangling="warn")).code == 0
    assert run(tree_of(spark, lost | {"t.md": "[d](d)"}), GateConfig(create_readme=True)).counts["create_readme"] == 1
    staged, hunks = spark.createDataFrame([("s.md",)], "path string"), spark.createDataFrame([("s.md", 2, 1)], "path string, start_line int, n_lines int")
    assert run(tree, GateConfig(scope="staged", dangling="added-lines"), staged, hunks).code == 0
    assert run(tree, GateConfig(scope="staged", dangling="added-lines"), staged, spark.createDataFrame([("s.md", 1, 1)], hunks.schema)).code == 1
