"""Tokenisers against plain scanners, on random texts."""

from __future__ import annotations

import os
import posixpath
import random
import re
import urllib.parse

from pyspark.sql import functions as F

from linkgraph.functions import frontmatter, paths, tokens

#: Fixed patterns of the format, in their plainest form.
HREF = rf"(?:(?:[^()\s]|\((?:[^()\s]|\([^()\s]*\))*\))+|[^)]+)"
LINK = rf"\[([^\]]*)\]\(({HREF})\)"
ATTRS = r'\{(?:[^{}"\n]|"[^"\n]*")*\}'
COMMENT = r"<!--\s*uuid:\s*([0-9a-fA-F-]{36})\s*-->"
U = "0123456789abcdef0123456789abcdef0123"


def fences(text):
    out, at, fence = [], 0, None
    for line in text.splitlines(keepends=True):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence is None and m:
            fence = (m[1], at)
        elif fence and m and re.fullmatch(r" {0,3}(`{3,}|~{3,})\s*", line) and m[1][0] == fence[0][0] and len(m[1]) >= len(fence[0]):
            out.append((fence[1], at + len(line)))
            fence = None
        at += len(line)
    return [*out, (fence[1], len(text))] if fence else out


def inline(text, fenced):
    out, at = [], 0
    for s, e in [*fenced, (len(text), len(text))]:
        runs = list(re.finditer("`+", text[at:s]))
        i = 0
        while i < len(runs):
            close = next((j for j in range(i + 1, len(runs)) if len(runs[j][0]) == len(runs[i][0])), None)
            if close is not None:
                out.append((at + runs[i].start(), at + runs[close].end()))
            i = i + 1 if close is None else close + 1
        at = e
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = ["[", "](", ")", "(", "a", "b.md", " ", "\n", "\r\n", "```", "~~~", "`", "``", "{.c}", '{k="}"}', f"<!-- uuid: {U} -->", f"<!--uuid:{U.upper()}-->", "<!-- x -->", "é", "😀", "    ", "\x1c", " ", "[t](p/q.md)", "[u](x(y)z)", "https://h/x", "!"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_tokenisers_agree_with_plain_scanners(spark):
    texts = random_texts(3000, 1)
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").withColumn("fenced", tokens.fenced_spans(t))
    df = df.withColumn("inline", tokens.inline_spans(t, F.col("fenced"))).withColumn("code", F.concat("fenced", "inline")).withColumn("found", tokens.scan(t))
    found, code = F.col("found"), F.col("code")
    rows = df.select("i", "fenced", "inline", tokens.robust_links(found, code).alias("robust"), tokens.plain_links(found, code).alias("plain"), tokens.detached_anchors(found, code).alias("strays")).collect()
    for row in rows:
        text = texts[row.i]
        fenced = fences(text)
        spans = inline(text, fenced)
        assert [(x.s, x.e) for x in row.fenced] == fenced, repr(text)
        assert [(x.s, x.e) for x in row.inline] == spans, repr(text)
        outside = lambda p: not any(s <= p < e for s, e in [*fenced, *spans])  # noqa: B023, E731
        robust = [(m.start(), m.end(), text.count("\n", 0, m.start()) + 1, m[1], m[2], m[3] or "", m[4]) for m in re.finditer(rf"{LINK}({ATTRS})?\s*{COMMENT}", text) if outside(m.start())]
        assert [(x.s, x.e, x.line, x.text, x.href, x.attrs, x.uuid) for x in row.robust] == robust, repr(text)
        plain, attached = [], set()
        for m in re.finditer(LINK, text):
            attrs = re.compile(ATTRS).match(text, m.end())
            tail = re.compile(rf"\s*{COMMENT}").match(text, attrs.end() if attrs else m.end())
            if tail:
                attached.add(tail.end())
            elif outside(m.start()):
                plain.append((m.start(), m.end(), m[2]))
        assert [(x.s, x.e, x.href) for x in row.plain] == plain, repr(text)
        gap = lambda before: len(before) - len(before.rstrip(" \t"))
        strays = [(m.start(), m.end(), text.count("\n", 0, m.start()) + 1, gap(text[: m.start()])) for m in re.finditer(COMMENT, text) if m.end() not in attached and outside(m.start())]
        assert [(x.s, x.e, x.line, x.gap) for x in row.strays] == strays, repr(text)


def test_long_hrefs_do_not_exhaust_the_stack(spark):
    texts = ["[a](" + "x" * 200_000 + ")", "[a](" + "(x)" * 3000 + ")", "[a](" + "(" * 5000 + "b) [c](d)"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(tokens.scan(F.col("t"), ("links",))["links"].alias("l")).collect()
    assert [[x.href for x in r.l] for r in rows] == [[m[2] for m in re.finditer(LINK, x)] for x in texts]


def test_paths(spark):
    rng = random.Random(2)
    made = lambda: "/".join(rng.choice(["a", "b", "..", ".", "", "c d"]) for _ in range(rng.randint(1, 6)))
    rows = [(made(), posixpath.normpath("r/" + made()).lstrip("/"), posixpath.normpath("r/" + made()).lstrip("/")) for _ in range(800)]
    rows = [x for x in rows if ".." not in x[1] and ".." not in x[2] and not x[0].startswith("/")]
    found = spark.createDataFrame(rows, "p string, a string, b string").select("p", "a", "b", paths.normalised(F.col("p")).alias("n"), paths.relative(F.col("a"), F.col("b")).alias("r")).collect()
    for x in found:
        assert x.n == posixpath.normpath(x.p or "."), x
        assert x.r == posixpath.relpath(x.a, x.b), x


def test_percent_decoding(spark):
    texts = ["a%20b", "100%", "%zz", "a+b", "%C3%A9", "%ff", "%2Fetc", ""]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(paths.percent_decoded(F.col("t")).alias("d")).collect()
    assert [x.d for x in got] == [urllib.parse.unquote(x) for x in texts]


def test_globs(spark):
    names = ["old", "old_1", "x_old", "cold", "Old", "a[b", "node_modules"]
    df = spark.createDataFrame([(x,) for x in names], "n string")
    match = lambda *globs: [x.n for x in df.where(paths.matches_any(F.col("n"), globs)).collect()]
    assert match("old*") == ["old", "old_1"] and match("?old") == ["cold"] and match("[!x]old", "*_1") == ["old_1", "cold"] and match("a[[]b") == ["a[b"]


def test_frontmatter(spark):
    u = "abcdef01-2345-6789-abcd-ef0123456789"
    cases = {f"---\nuuid: {u}\n---\n": ("valid", u), f"---\nuuid: {u.upper()}\n---\nx": ("valid", u), "---\nuuid: [a]\n---\n": ("invalid", None), "---\nuuid: 12345\n---\n": ("invalid", None), "---\na: [\n---\n": ("invalid", None), "text": ("none", None), "---\ntitle: x\n---\n": ("valid", None), "---\n- a\n---\n": ("valid", None), "---\nuuid: ''\n---\n": ("valid", None), "": ("none", None), f"---\r\nuuid: {u}\r\n---\r\n": ("valid", u)}
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", frontmatter.read_uuid(F.col("t")).alias("f")).collect()
    for row in rows:
        assert (row.f.status, row.f.uuid) == cases[row.t], row.t
    assert os.linesep
