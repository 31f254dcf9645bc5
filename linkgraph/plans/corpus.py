"""A Markdown tree derived from the benchmark tables, so that the analyses have links to judge.

Every row of a table is a document, and its key decides what is in it.  The expressions are
SQL that Spark and other engines read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut

#: Options of all registered queries.
OPTIONS = Options(ignore_blocks=("toc",), mint_seed="")


def uuid(text: str) -> str:
    """SQL of a uuid made from the SQL expression text."""
    h = f"md5({text})"
    return "concat(" + ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def named(kind: str, key: str) -> str:
    return uuid(f"concat('{kind}-', {key})")


def anchor(value: str) -> str:
    return f"' <!-- uuid: ', {value}, ' -->'"


C, N, R = named("customer", "c"), named("nation", "n"), named("region", "r")
#: The uuid that suppliers 5 and 6 of every ten share, for the first ten.
SHARED = named("suppliers", "0")
STALE = f"concat('[c](../old/', c, '.md)', {anchor(C)})"

#: What links an order's document holds, by o_orderkey % 16; k order, c customer, n nation, r region.
ORDER_LINK = f"""CASE k % 16
  WHEN 0 THEN concat('[c](../customer/', c, '.md)', {anchor(C)})
  WHEN 1 THEN {STALE}
  WHEN 2 THEN concat('[c](../old/', c, '.md#sec)', {anchor(C)})
  WHEN 3 THEN concat('[c](../customer/', c, '.md)', {anchor(f"upper({C})")})
  WHEN 4 THEN concat('[c](../customer/', c, '.md)', {anchor(named("nobody", "k"))})
  WHEN 5 THEN concat('[s](../supplier/5.md)', {anchor(SHARED)})
  WHEN 6 THEN concat('[c](../nation/', n, '.md)', {anchor(C)})
  WHEN 7 THEN concat('[r](../oldregion/)', {anchor(R)})
  WHEN 8 THEN concat('[c](../customer/', c, '.md)', chr(123), '.cls', chr(125))
  WHEN 9 THEN '[s](../supplier/0.md)'
  WHEN 10 THEN concat('[m](../customer/missing-', k, '.md)')
  WHEN 11 THEN concat('[m](../customer/missing%20', k, '.csv)')
  WHEN 12 THEN concat('[a](/srv/', k, '.md)')
  WHEN 13 THEN concat('[w](https://github.com/own/repo/blob/', CASE WHEN k % 3 = 0 THEN 'main' ELSE 'abcdef0123' END, '/docs/', k, '.md)', CASE WHEN k % 5 = 0 THEN concat(' <!-- web-uuid: ', {named("web", "k")}, ' -->') ELSE '' END)
  WHEN 14 THEN concat(chr(10), '```', chr(10), {STALE}, chr(10), '```')
  ELSE concat('`', {STALE}, '` and ``', {STALE}, '``') END"""

ORDERS = f"""SELECT k, c, n, r, concat('orders/', k, '.md') AS path, concat('# Order ', k, chr(10), chr(10), 'see ', {ORDER_LINK}, chr(10)) AS content
FROM (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""

#: By p_partkey % 8; k part, c a customer.
PART_TEXT = f"""CASE k % 8
  WHEN 0 THEN concat('<!-- linkgraph-ignore-links -->', chr(10), {STALE})
  WHEN 1 THEN concat('<!-- toc-start -->', chr(10), {STALE}, chr(10), '<!-- toc-end -->')
  WHEN 2 THEN concat('[r](../region/', r, '/)')
  WHEN 3 THEN '[n](../nation)'
  WHEN 4 THEN concat('[c](../customer/', c, '.md) and', {anchor(C)}, ' more')
  WHEN 5 THEN concat('[me](', k, '.md)')
  WHEN 6 THEN '[s](../supplier/3.md)'
  ELSE '[s](../supplier/2.md)' END"""

PARTS = f"""SELECT k, c, r, concat('part/', k, '.md') AS path, concat('# Part ', k, chr(10), {PART_TEXT}, chr(10)) AS content
FROM (SELECT p_partkey AS k, 1 + p_partkey % 100 AS c, p_partkey % 5 AS r FROM part)"""

#: By s_suppkey % 10; k supplier.
SUPPLIERS = f"""SELECT k, concat('supplier/', k, '.md') AS path, CASE k % 10
  WHEN 0 THEN concat('# Supplier ', k, chr(10))
  WHEN 1 THEN concat('---', chr(10), 'uuid: [', k, chr(10), '---', chr(10))
  WHEN 2 THEN concat('---', chr(10), 'title: s', chr(10), '---', chr(10))
  WHEN 3 THEN concat('---', chr(10), 'uuid: ', {named("supplier", "k")}, chr(10), '---', chr(10), '<!-- linkgraph-ignore-file -->', chr(10))
  WHEN 4 THEN concat('---', chr(10), 'uuid: ', upper({named("supplier", "k")}), chr(10), '---', chr(10))
  WHEN 5 THEN concat('---', chr(10), 'uuid: ', {named("suppliers", "(k - 5)")}, chr(10), '---', chr(10))
  WHEN 6 THEN concat('---', chr(10), 'uuid: ', {named("suppliers", "(k - 6)")}, chr(10), '---', chr(10))
  ELSE concat('---', chr(10), 'uuid: ', {named("supplier", "k")}, chr(10), '---', chr(10), '# Supplier', chr(10)) END AS content
FROM (SELECT s_suppkey AS k FROM supplier)"""


def _plain(kind: str, column: str, table: str, path: str) -> str:
    return f"SELECT concat({path}) AS path, concat('---', chr(10), 'uuid: ', {named(kind, 'k')}, chr(10), '---', chr(10), '# ', k, chr(10)) AS content FROM (SELECT {column} AS k FROM {table})"


DOCS = " UNION ALL ".join(
    [
        f"SELECT path, content FROM ({ORDERS})", f"SELECT path, content FROM ({PARTS})", f"SELECT path, content FROM ({SUPPLIERS})",
        _plain("customer", "c_custkey", "customer", "'customer/', k, '.md'"), _plain("nation", "n_nationkey", "nation", "'nation/', k, '.md'"), _plain("region", "r_regionkey", "region", "'region/', k, '/README.md'"),
    ]
)

#: Results of fetches, by o_orderkey % 7.
FETCHES = f"""SELECT concat('https://github.com/own/repo/blob/', CASE WHEN k % 3 = 0 THEN 'main' ELSE 'abcdef0123' END, '/docs/', k, '.md') AS href,
  CASE k % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN -1 ELSE 200 END AS status,
  CASE WHEN k % 7 = 3 THEN '# no uuid' WHEN k % 7 = 4 THEN concat('---', chr(10), 'uuid: ', {named("other", "k")}, chr(10), '---', chr(10)) WHEN k % 7 > 4 THEN concat('---', chr(10), 'uuid: ', {named("web", "k")}, chr(10), '---', chr(10)) END AS body
FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 16 = 13"""

TABLES = ("orders", "customer", "nation", "region", "part", "supplier")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(sql, **{k: v for k, v in frames.items() if f"{{{k}}}" in sql})


def tree(spark: SparkSession, sf_dir: str, once: bool = False) -> Tree:
    """once: the documents are read by one pass only; else they are materialised, for their expressions would be part of the plan of every lookup."""
    docs = query(spark, sf_dir, DOCS)
    return Tree.of(docs if once else cut(docs), options=OPTIONS)


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, FETCHES).withColumn("status", F.col("status").cast("int"))
