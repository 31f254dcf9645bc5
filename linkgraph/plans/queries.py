"""The registered queries over the derived tree, and SQL that gives the same rows from the keys, without reading text."""

from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions import frontmatter, paths
from linkgraph.operators import check, documents, gate, repair, robustify, splice, web
from linkgraph.operators.documents import Tree
from linkgraph.plans import corpus
from linkgraph.plans.corpus import OPTIONS, C, R, anchor, named
from linkgraph.plans.cut import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_KEYS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n, n_regionkey AS r, o_orderkey % 16 AS st, concat('orders/', o_orderkey, '.md') AS path
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT p_partkey AS k, 1 + p_partkey % 100 AS c, p_partkey % 5 AS r, p_partkey % 8 AS st, concat('part/', p_partkey, '.md') AS path FROM part),
s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS st, concat('supplier/', s_suppkey, '.md') AS path FROM supplier)
"""


def _minted(path: str) -> str:
    h = hashlib.sha256(f"\0{path}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{'89ab'[ord(h[16]) % 4]}{h[17:20]}-{h[20:32]}"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        ORACLE_SQL[name] = (_KEYS if sql.lstrip().startswith("SELECT") and "FROM pages" not in sql else "") + sql
        return run

    return add


def _docs(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return documents.prepared(corpus.tree(spark, sf_dir, once=not kinds), OPTIONS, kinds)


_UUIDS = f"""SELECT uuid, count(*) AS n, min(path) AS path FROM (
  SELECT {named("customer", "c_custkey")} AS uuid, concat('customer/', c_custkey, '.md') AS path FROM customer
  UNION ALL SELECT {named("nation", "n_nationkey")}, concat('nation/', n_nationkey, '.md') FROM nation
  UNION ALL SELECT {named("region", "r_regionkey")}, concat('region/', r_regionkey, '/README.md') FROM region
  UNION ALL SELECT CASE WHEN st = 5 THEN {named("suppliers", "(k - 5)")} WHEN st = 6 THEN {named("suppliers", "(k - 6)")} ELSE {named("supplier", "k")} END, path FROM s WHERE st >= 4
) GROUP BY uuid"""


@query("uuid_index", _UUIDS)
def uuid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.uuid_index(_docs(spark, sf_dir)).select("uuid", "n", "path")


@query("duplicate_uuids", f"SELECT {named('suppliers', '(k - st)')} AS uuid, path FROM s WHERE st IN (5, 6)")
def duplicate_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.duplicate_uuids(_docs(spark, sf_dir))


_OUT = {"ignored_files": ("ignored", "s WHERE st = 3"), "link_ignored": ("link_ignored", "p WHERE st = 0"), "invalid_frontmatter": ("NOT ignored AND fm_status = 'invalid'", "s WHERE st = 1")}
for _name, (_where, _from) in _OUT.items():
    query(_name, f"SELECT path FROM {_from}")(lambda spark, sf_dir, where=_where: _docs(spark, sf_dir).where(where).select("path"))

_ORDER_HREF = """CASE WHEN st IN (0, 3, 4, 8) THEN concat('../customer/', c, '.md') WHEN st = 1 THEN concat('../old/', c, '.md') WHEN st = 2 THEN concat('../old/', c, '.md#sec')
  WHEN st = 5 THEN '../supplier/5.md' WHEN st = 6 THEN concat('../nation/', n, '.md') WHEN st = 7 THEN '../oldregion/' WHEN st = 9 THEN '../supplier/0.md'
  WHEN st = 10 THEN concat('../customer/missing-', k, '.md') WHEN st = 11 THEN concat('../customer/missing%20', k, '.csv') WHEN st = 12 THEN concat('/srv/', k, '.md')
  WHEN st = 13 THEN concat('https://github.com/own/repo/blob/', CASE WHEN k % 3 = 0 THEN 'main' ELSE 'abcdef0123' END, '/docs/', k, '.md') END"""
_ORDER_UUID = f"CASE WHEN st = 4 THEN {named('nobody', 'k')} WHEN st = 5 THEN {corpus.SHARED} WHEN st = 7 THEN {R} ELSE {C} END"
_PART_HREF = "CASE st WHEN 2 THEN concat('../region/', r, '/') WHEN 3 THEN '../nation' WHEN 4 THEN concat('../customer/', c, '.md') WHEN 5 THEN concat(k, '.md') WHEN 6 THEN '../supplier/3.md' ELSE '../supplier/2.md' END"


@query("robust_links", f"SELECT path, 3 AS line, CAST(14 + length(CAST(k AS VARCHAR)) AS INTEGER) AS start, {_ORDER_HREF} AS href, {_ORDER_UUID} AS uuid FROM o WHERE st < 8")
def robust_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.robust_links(_docs(spark, sf_dir, "robust")).select("path", "line", F.col("s").alias("start"), "href", "uuid")


@query("plain_links", f"SELECT path, 3 AS line, {_ORDER_HREF} AS href FROM o WHERE st BETWEEN 8 AND 13 UNION ALL SELECT path, 2, {_PART_HREF} FROM p WHERE st >= 2")
def plain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustify.plain_links(_docs(spark, sf_dir, "plain")).select("path", "line", "href")


@query("detached_anchors", f"SELECT path, 2 AS line, {C} AS uuid, 1 AS gap FROM p WHERE st = 4")
def detached_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustify.detached(_docs(spark, sf_dir, "strays")).select("path", "line", "uuid", "gap")


_REPAIR_KIND = "CASE st WHEN 4 THEN 'unresolvable' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'conflict' ELSE 'repair' END"
_REPAIRS = f"SELECT {_REPAIR_KIND} AS kind, path, CAST(3 AS INTEGER) AS line, {_ORDER_HREF} AS href, {_ORDER_UUID} AS uuid FROM o WHERE st IN (1, 2, 4, 5, 6, 7) UNION ALL SELECT 'ignored_links', path, 0, NULL, NULL FROM p WHERE st = 0"


@query("repair_findings", _REPAIRS)
def repair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.plan(corpus.tree(spark, sf_dir), OPTIONS).findings.select("kind", "path", F.coalesce("line", F.lit(0)).alias("line"), "href", "uuid")


for _kind in ("conflict", "unresolvable", "ambiguous"):
    query(f"repair_{_kind}", f"SELECT path, href, uuid FROM ({_REPAIRS}) WHERE kind = '{_kind}'")(
        lambda spark, sf_dir, kind=_kind: repair.plan(corpus.tree(spark, sf_dir), OPTIONS).findings.where(F.col("kind") == kind).select("path", "href", "uuid")
    )

_FIXED = f"""CASE st WHEN 7 THEN concat('[r](../region/', r, '/)', {anchor(R)}) WHEN 2 THEN concat('[c](../customer/', c, '.md#sec)', {anchor(C)}) ELSE concat('[c](../customer/', c, '.md)', {anchor(C)}) END"""


@query("repair_rewrites", f"SELECT path, md5(concat('# Order ', k, chr(10), chr(10), 'see ', {_FIXED}, chr(10))) AS digest FROM o WHERE st IN (1, 2, 7)")
def repair_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.plan(corpus.tree(spark, sf_dir), OPTIONS).rewrites().select("path", F.md5("new_content").alias("digest"))


@query("write_scope_suppressed", "SELECT path, CAST(1 AS BIGINT) AS n FROM o WHERE st IN (1, 2, 4, 5, 6, 7) AND k % 3 <> 0")
def write_scope_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus.query(spark, sf_dir, "SELECT concat('orders/', o_orderkey, '.md') AS path FROM orders WHERE o_orderkey % 3 = 0")
    return repair.plan(corpus.tree(spark, sf_dir), OPTIONS, scope).suppressed


_STRICT = f"""SELECT CASE st WHEN 8 THEN 'robustify' WHEN 9 THEN 'no_frontmatter' WHEN 12 THEN 'absolute_local_path' ELSE 'dangling' END AS kind, path, CAST(3 AS INTEGER) AS line, {_ORDER_HREF} AS href FROM o WHERE st BETWEEN 8 AND 12
UNION ALL SELECT 'robustify', path, 2, {_PART_HREF} FROM p WHERE st IN (2, 4, 7) UNION ALL SELECT 'ignored_links', path, 0, NULL FROM p WHERE st = 0"""


@query("robustify_findings", _STRICT)
def robustify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).findings.select("kind", "path", F.coalesce("line", F.lit(0)).alias("line"), "href")


for _kind in ("dangling", "absolute_local_path", "no_frontmatter"):
    query(_kind, f"SELECT path, line, href FROM ({_STRICT}) WHERE kind = '{_kind}'")(
        lambda spark, sf_dir, kind=_kind: robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).findings.where(F.col("kind") == kind).select("path", "line", "href")
    )


@query(
    "target_decisions",
    """SELECT target, outcome FROM (
  SELECT DISTINCT concat('customer/', c, '.md') AS target, 'reuse' AS outcome FROM (SELECT c FROM o WHERE st = 8 UNION ALL SELECT c FROM p WHERE st = 4)
  UNION ALL SELECT DISTINCT concat('region/', r, '/README.md'), 'reuse' FROM p WHERE st = 2
  UNION ALL SELECT 'supplier/0.md', 'no_frontmatter' UNION ALL SELECT 'supplier/3.md', 'opted_out' UNION ALL SELECT 'supplier/2.md', 'mint')""",
)
def target_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).decisions.select("target", "outcome")


_NEW = _minted("supplier/2.md")


@query(
    "robustify_rewrites",
    f"""SELECT path, md5(concat('# Order ', k, chr(10), chr(10), 'see [c](../customer/', c, '.md)', chr(123), '.cls', chr(125), {anchor(C)}, chr(10))) AS digest FROM o WHERE st = 8
UNION ALL SELECT path, md5(concat('# Part ', k, chr(10), CASE st WHEN 2 THEN concat('[r](../region/', r, '/)', {anchor(R)}) WHEN 4 THEN concat('[c](../customer/', c, '.md)', {anchor(C)}, ' and more') ELSE '[s](../supplier/2.md) <!-- uuid: {_NEW} -->' END, chr(10))) FROM p WHERE st IN (2, 4, 7)
UNION ALL SELECT path, md5(concat('---', chr(10), 'uuid: {_NEW}', chr(10), 'title: s', chr(10), '---', chr(10))) FROM s WHERE k = 2""",
)
def robustify_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).rewrites().select("path", F.md5("new_content").alias("digest"))


@query("create_readme", f"SELECT 'nation/README.md' AS path, md5(concat('---', chr(10), 'uuid: {_minted('nation/README.md')}', chr(10), '---', chr(10), chr(10), '# nation', chr(10))) AS digest")
def create_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = replace(OPTIONS, create_readme=True)
    return robustify.plan(corpus.tree(spark, sf_dir), options).created.select("path", F.md5("new_content").alias("digest"))


_AXES = f"""SELECT axis, kind, count(*) AS n FROM (
  SELECT 'integrity' AS axis, kind FROM ({_REPAIRS}) UNION ALL SELECT 'integrity', 'invalid_frontmatter' FROM s WHERE st = 1
  UNION ALL SELECT CASE WHEN kind IN ('dangling', 'absolute_local_path') THEN kind ELSE 'strict' END, kind FROM ({_STRICT})) GROUP BY axis, kind"""


@query("check_axes", _AXES)
def check_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check(corpus.tree(spark, sf_dir), OPTIONS).counts()


@query(
    "check_verdict",
    f"""SELECT broken, loose, CASE WHEN broken > 0 THEN 2 WHEN loose > 0 THEN 3 ELSE 0 END AS code FROM (
  SELECT count(*) FILTER (axis = 'integrity' AND kind <> 'ignored_links') AS broken, count(*) FILTER (axis = 'strict' AND kind = 'robustify') AS loose
  FROM (SELECT axis, kind, unnest(generate_series(1, n)) FROM ({_AXES})))""",
)
def check_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check(corpus.tree(spark, sf_dir), OPTIONS).verdict()


@query("web_links", f"SELECT path, 3 AS line, {_ORDER_HREF} AS href, CASE WHEN k % 5 = 0 THEN {named('web', 'k')} END AS uuid, false AS exempt FROM o WHERE st = 13")
def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.web_links(_docs(spark, sf_dir, "web")).select("path", "line", "href", "uuid", "exempt")


_WEB = f"""SELECT path, {_ORDER_HREF} AS href, CASE WHEN k % 7 < 3 THEN 'web_unverifiable' WHEN k % 5 <> 0 AND k % 7 > 3 THEN 'web_anchor' WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'web_own_no_uuid'
  WHEN k % 5 <> 0 THEN 'web_unverifiable' WHEN k % 7 > 4 THEN 'web_ok' ELSE 'web_mismatch' END AS kind FROM o WHERE st = 13"""


def _web(spark: SparkSession, sf_dir: str) -> web.WebCheck:
    return web.check(corpus.tree(spark, sf_dir), corpus.fetches(spark, sf_dir), OPTIONS, owners=("Own",))


@query("web_classify", _WEB)
def web_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).findings.select("path", "href", "kind")


@query(
    "web_verdict",
    f"""SELECT anchors, problems, own, CASE WHEN problems > 0 OR own > 5 THEN 4 WHEN anchors > 0 THEN 3 ELSE 0 END AS code FROM (
  SELECT count(*) FILTER (kind = 'web_anchor') AS anchors, count(*) FILTER (kind = 'web_mismatch') AS problems, count(*) FILTER (kind = 'web_own_no_uuid') AS own FROM ({_WEB}))""",
)
def web_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).verdict(own_max=5)


@query(
    "web_rewrites",
    f"""SELECT path, md5(concat('# Order ', k, chr(10), chr(10), 'see [w](', {_ORDER_HREF}, ') <!-- web-uuid: ', CASE WHEN k % 7 = 4 THEN {named("other", "k")} ELSE {named("web", "k")} END, ' -->', chr(10))) AS digest
FROM o WHERE st = 13 AND k % 5 <> 0 AND k % 7 > 3""",
)
def web_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).rewrites().select("path", F.md5("new_content").alias("digest"))


@query("url_parse", f"SELECT {_ORDER_HREF} AS href, 'own' AS owner, 'repo' AS repo, CASE WHEN k % 3 = 0 THEN 'main' ELSE 'abcdef0123' END AS ref, concat('docs/', k, '.md') AS path FROM o WHERE st = 13")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fetches(spark, sf_dir).select("href", web.parsed_url(F.col("href")).alias("u")).select("href", "u.owner", "u.repo", "u.ref", "u.path")


@query("gate_staged", f"SELECT kind, count(*) AS n FROM (SELECT kind, path FROM ({_REPAIRS}) WHERE path IN (SELECT path FROM o WHERE k % 4 = 1)) GROUP BY kind")
def gate_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.query(spark, sf_dir, "SELECT concat('orders/', o_orderkey, '.md') AS path FROM orders WHERE o_orderkey % 4 = 1")
    return gate.staged(repair.plan(corpus.tree(spark, sf_dir), OPTIONS).findings, files).groupBy("kind").agg(F.count("*").alias("n"))


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = corpus.query(spark, sf_dir, "SELECT concat('orders/', o_orderkey, '.md') AS path, CASE o_orderkey % 3 WHEN 0 THEN '@@ -1,2 +2,2 @@' WHEN 1 THEN '@@ -3 +3 @@ x' ELSE '@@ -1,3 +1,2 @@' END AS header FROM orders")
    return gate.dangling(robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).findings, "added-lines", gate.hunks_of(diff))


@query("gate_added_lines", "SELECT path FROM o WHERE st IN (10, 11) AND k % 3 < 2")
def gate_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _added(spark, sf_dir).select("path")


@query("gate_budget", "SELECT n, 100 AS most, n <= 100 AS passes FROM (SELECT count(*) AS n FROM o WHERE st IN (10, 11) AND k % 3 < 2)")
def gate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.within_budget(_added(spark, sf_dir), 100)


@query(
    "href_classes",
    """SELECT href, starts_with(lower(trim(href)), 'http://') OR starts_with(lower(trim(href)), 'https://') AS web,
  split_part(href, '#', 1) <> '' AND NOT contains(href, '://') AND NOT regexp_matches(lower(href), '^(https?:|mailto:|ftp:|/)') AS local,
  starts_with(href, '/') AND NOT starts_with(href, '//') AS absolute, ends_with(lower(trim(split_part(href, '#', 1))), '.md') AS names_md, count(*) AS n
FROM (SELECT url AS href FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages) WHERE href IS NOT NULL GROUP BY href""",
)
def href_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hrefs = pages.select(F.col("url").alias("href")).unionByName(pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))).where("href IS NOT NULL")
    each, href = hrefs.groupBy("href").agg(F.count("*").alias("n")), F.col("href")
    return each.select("href", paths.is_web(href).alias("web"), paths.is_local_relative(href).alias("local"), paths.is_absolute_local(href).alias("absolute"), paths.names_md(href).alias("names_md"), "n")


@query(
    "relative_paths",
    """SELECT k, CASE k % 4 WHEN 0 THEN concat('../../c/', k, '.md') WHEN 1 THEN '.' WHEN 2 THEN '../../../d.md' ELSE concat('e', k) END AS rel,
  CASE k % 4 WHEN 0 THEN concat('a/c/', k, '.md') WHEN 1 THEN 'a/b/x' WHEN 2 THEN 'd.md' ELSE concat('a/b/x/e', k) END AS back FROM o""",
)
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a/b/x to a target, and back again by resolving what was found."""
    rows = corpus.query(spark, sf_dir, "SELECT k, CASE k % 4 WHEN 0 THEN concat('a/c/', k, '.md') WHEN 1 THEN 'a/b/x' WHEN 2 THEN 'd.md' ELSE concat('a/b/x/e', k) END AS target FROM (SELECT o_orderkey AS k FROM orders)")
    rel = paths.relative(F.col("target"), F.lit("a/b/x"))
    return rows.select("k", rel.alias("rel")).withColumn("back", paths.resolved(F.col("rel"), F.lit("a/b/x/doc.md")))


@query("backlinks", "SELECT concat('customer/', c, '.md') AS target, count(*) AS n FROM (SELECT c FROM o WHERE st IN (0, 3, 8) UNION ALL SELECT c FROM p WHERE st = 4) GROUP BY c ORDER BY n DESC, target LIMIT 20")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the twenty customers that most links name by their right path."""
    docs = cut(_docs(spark, sf_dir, "robust", "plain"))
    links = repair.robust_links(docs).select("path", "href", F.lit(True).alias("robust")).unionByName(robustify.plain_links(docs).select("path", "href", F.lit(False).alias("robust")))
    own = docs.select(F.col("path").alias("target"))
    to = links.withColumn("target", paths.resolved(F.col("href"), F.col("path"))).join(own, "target", "left_semi").where("target LIKE 'customer/%' ")
    wrong = repair.robust_links(docs).join(documents.uuid_index(docs).select("uuid"), "uuid", "left_anti").select("path", "href")
    to = to.join(wrong, ["path", "href"], "left_anti")
    return to.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(20)


@query(
    "check_report",
    f"""SELECT axis, kind, path, line, coalesce(href, '') AS href FROM (
  SELECT 'integrity' AS axis, kind, path, line, href FROM ({_REPAIRS}) UNION ALL SELECT 'integrity', 'invalid_frontmatter', path, 0, NULL FROM s WHERE st = 1
  UNION ALL SELECT CASE WHEN kind IN ('dangling', 'absolute_local_path') THEN kind ELSE 'strict' END, kind, path, line, href FROM ({_STRICT}))""",
)
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' JSON, read again."""
    found = check.check(corpus.tree(spark, sf_dir), OPTIONS).report()
    return found.select("axis", F.from_json("finding", "kind string, path string, line int, href string").alias("x")).select("axis", "x.kind", "x.path", F.coalesce("x.line", F.lit(0)).alias("line"), F.coalesce("x.href", F.lit("")).alias("href"))


@query(
    "gate_modes",
    f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 16 AS st FROM orders), found AS (SELECT axis, kind, n FROM ({_KEYS} {_AXES}))
SELECT mode, axis, kind, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'repair' AS mode, * FROM found WHERE axis = 'integrity' UNION ALL SELECT 'check', * FROM found WHERE axis IN ('integrity', 'strict') UNION ALL SELECT 'max', * FROM found WHERE axis IN ('integrity', 'strict')
  UNION ALL SELECT 'max', 'strict', 'robustify', count(*) FROM o WHERE st = 9) GROUP BY mode, axis, kind""",
)
def gate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = corpus.tree(spark, sf_dir)
    found, more = check.check(tree, OPTIONS).findings, robustify.plan(tree, replace(OPTIONS, create_frontmatter=True)).findings
    modes = [gate.by_mode(found, mode, more).groupBy("axis", "kind").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "*") for mode in gate.MODES]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("gate_rungs", "SELECT rung, CASE rung WHEN 'repo' THEN n ELSE 0 END AS n FROM (SELECT count(*) AS n FROM o WHERE st IN (10, 11)), (SELECT unnest(['off', 'warn', 'repo']) AS rung)")
def gate_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(robustify.plan(corpus.tree(spark, sf_dir), OPTIONS).findings)
    rungs = [gate.dangling(found, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("rung"), "n") for x in ("off", "warn", "repo")]
    return rungs[0].unionByName(rungs[1]).unionByName(rungs[2])


@query("deny_listed", "SELECT path, CAST(2 AS INTEGER) AS line, '../supplier/2.md' AS href FROM p WHERE st = 7")
def deny_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robustify.plan(corpus.tree(spark, sf_dir), replace(OPTIONS, deny_globs=("[2]*",))).findings
    return found.where("kind = 'deny_listed'").select("path", "line", "href")


@query("target_writes_refused", "SELECT path, '../supplier/2.md' AS href FROM p WHERE st = 7 AND k % 3 = 0")
def target_writes_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus.query(spark, sf_dir, "SELECT concat('part/', p_partkey, '.md') AS path FROM part WHERE p_partkey % 3 = 0")
    found = robustify.plan(corpus.tree(spark, sf_dir), replace(OPTIONS, allow_target_writes=False), scope).findings
    return found.where("kind = 'target_write_refused'").select("path", "href")


@query("target_writes", "SELECT DISTINCT 'supplier/2.md' AS path FROM p WHERE st = 7 AND k % 3 = 0")
def target_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus.query(spark, sf_dir, "SELECT concat('part/', p_partkey, '.md') AS path FROM part WHERE p_partkey % 3 = 0")
    return robustify.plan(corpus.tree(spark, sf_dir), OPTIONS, scope).findings.where("kind = 'target_uuid_write'").select("path")


@query("robustify_suppressed", "SELECT path, CAST(1 AS BIGINT) AS n FROM p WHERE st IN (2, 4) AND k % 3 <> 0 UNION ALL SELECT path, 1 FROM o WHERE st = 8")
def robustify_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus.query(spark, sf_dir, "SELECT concat('part/', p_partkey, '.md') AS path FROM part WHERE p_partkey % 3 = 0")
    return robustify.plan(corpus.tree(spark, sf_dir), OPTIONS, scope).suppressed


@query("excluded_folders", "SELECT 'orders' AS folder, count(*) AS n FROM o UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def excluded_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tree.of(corpus.query(spark, sf_dir, corpus.DOCS), options=replace(OPTIONS, excludes=("supp*", "re?ion", "Part")))
    return tree.docs.groupBy(F.split("path", "/")[0].alias("folder")).agg(F.count("*").alias("n"))


@query("crlf_insertion", f"SELECT path, md5(concat('---', chr(13), chr(10), 'uuid: ', {named('supplier', 'k')}, chr(13), chr(10), CASE st WHEN 2 THEN concat('title: s', chr(13), chr(10), '---', chr(13), chr(10)) ELSE concat('---', chr(13), chr(10), chr(13), chr(10), '# Supplier ', k, chr(13), chr(10)) END)) AS digest FROM s WHERE st IN (0, 2)")
def crlf_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uuid given to documents whose lines end in carriage return and line feed, with and without a block."""
    rows = corpus.query(spark, sf_dir, f"SELECT path, {named('supplier', 'k')} AS uuid, replace(content, chr(10), concat(chr(13), chr(10))) AS content FROM ({corpus.SUPPLIERS}) WHERE k % 10 IN (0, 2)")
    text = F.col("content")
    edit = frontmatter.uuid_insertion(frontmatter.head_length(text), frontmatter.has_frontmatter(text), frontmatter.newline(text), F.col("uuid"))
    return rows.select("path", F.md5(splice.spliced(text, F.array(edit))).alias("digest"))


@query("plain_uuids", f"SELECT path, CASE WHEN st = 1 THEN concat('[', k) WHEN st = 5 THEN {named('suppliers', '(k - 5)')} WHEN st = 6 THEN {named('suppliers', '(k - 6)')} WHEN st >= 3 THEN {named('supplier', 'k')} END AS uuid FROM s")
def plain_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.query(spark, sf_dir, corpus.SUPPLIERS).select("path", frontmatter.plain_uuid(F.col("content")).alias("uuid"))


_ODD_URL = ("ö w", "r~*", "a b%20c/é(x)+&=,.md", "v1/x?")


def _quoted_url() -> str:
    owner, repo, path, ref = (urllib.parse.quote(x, safe="/%" if k == 2 else "%") for k, x in enumerate(_ODD_URL))
    return f"https://api.github.com/repos/{owner}/{repo}/contents/{path}?ref={ref}"


@query("contents_urls", f"SELECT k, CASE WHEN k % 2 = 0 THEN '{_quoted_url()}' ELSE concat('https://api.github.com/repos/own/repo/contents/docs/', k, '%20.md?ref=main') END AS address FROM o")
def contents_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.struct(*(F.lit(x).alias(n) for x, n in zip(_ODD_URL, ("owner", "repo", "path", "ref"), strict=True)))
    plain = F.struct(F.lit("own").alias("owner"), F.lit("repo").alias("repo"), F.concat(F.lit("docs/"), F.col("k").cast("string"), F.lit("%20.md")).alias("path"), F.lit("main").alias("ref"))
    rows = corpus.query(spark, sf_dir, "SELECT o_orderkey AS k FROM orders")
    return rows.select("k", F.when(F.col("k") % 2 == 0, web.contents_url(odd)).otherwise(web.contents_url(plain)).alias("address"))


@query("web_tokens", f"SELECT path, {_ORDER_HREF} AS href, k % 7 < 2 AS token_would_help, CASE WHEN k % 7 > 3 AND k % 5 <> 0 THEN CASE WHEN k % 7 = 4 THEN {named('other', 'k')} ELSE {named('web', 'k')} END END AS anchored FROM o WHERE st = 13")
def web_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).findings.select("path", "href", "token_would_help", "anchored")


@query("web_with_token", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN 'web_not_found' ELSE kind END AS kind FROM (SELECT k, w.kind FROM o JOIN ({_WEB}) w USING (path))) GROUP BY kind")
def web_with_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.check(corpus.tree(spark, sf_dir), corpus.fetches(spark, sf_dir), OPTIONS, owners=("Own",), have_token=True)
    return found.findings.groupBy("kind").agg(F.count("*").alias("n"))
