"""Robust links: what became of their targets, and the rewrites that bring their paths up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions import paths, tokens
from linkgraph.operators import documents, splice
from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut


@dataclass(frozen=True)
class Repair:
    """findings; edits; suppressed (path, n): findings of documents outside the scope; read: the prepared documents."""

    findings: DataFrame
    edits: DataFrame
    suppressed: DataFrame
    docs: DataFrame
    read: DataFrame

    def rewrites(self) -> DataFrame:
        return splice.rewrites(self.docs, self.edits)


def robust_links(docs: DataFrame) -> DataFrame:
    """path, s, e, line, text, href, attrs, uuid of the robust links that are read, web links among them."""
    rows = docs.select("path", F.explode("robust").alias("l"))
    return rows.select("path", *(F.col(f"l.{k}").alias(k) for k in ("s", "e", "line", "text", "href", "attrs")), F.lower("l.uuid").alias("uuid"))


def verdicts(docs: DataFrame, tree: Tree) -> DataFrame:
    """Each local robust link with kind (null where nothing is wrong), target and new_href."""
    links = robust_links(docs).where(~paths.is_web(F.col("href")))
    index = documents.uuid_index(docs).select("uuid", "n", F.col("path").alias("target"))
    rows = links.join(index, "uuid", "left").withColumn("current", paths.resolved(F.col("href"), F.col("path")))
    rows = documents.with_type(rows, "current", "type", tree)
    of_dir = ~paths.names_md(F.col("href"))
    intended = F.when(of_dir, paths.parent(F.col("target"))).otherwise(F.col("target"))
    base = paths.relative(intended, paths.parent(F.col("path")))
    base = F.when(of_dir, F.concat(base, F.lit("/"))).otherwise(base)
    tail = paths.fragment(F.col("href"))
    kind = (
        F.when(F.col("n") > 1, "ambiguous")
        .when(F.col("n").isNull(), "unresolvable")
        .when(of_dir & (F.lower(paths.basename(F.col("target"))) != paths.ANCHOR_NAME.lower()), "conflict")
        .when(F.col("current") == intended, None)
        .when(F.when(of_dir, F.col("type").isNotNull()).otherwise(F.coalesce(F.col("type") == "file", F.lit(False))), "conflict")
        .otherwise("repair")
    )
    rows = rows.withColumn("kind", kind).withColumn("of_dir", of_dir)
    return rows.withColumn("new_href", F.when(F.col("kind") == "repair", F.when(tail != "", F.concat(base, F.lit("#"), tail)).otherwise(base)))


def plan(tree: Tree, options: Options = Options(), scope: DataFrame | None = None, docs: DataFrame | None = None) -> Repair:
    """scope: the documents (path) whose links may be rewritten and reported; all are read as targets. docs: prepared already."""
    docs = cut(documents.prepared(tree, options, ("robust",))) if docs is None else docs
    rows = cut(documents.scoped(verdicts(docs, tree).where("kind IS NOT NULL"), scope))
    target = F.coalesce("target", F.lit(""))
    detail = (
        F.when(F.col("kind") == "ambiguous", F.concat(F.lit("several documents declare uuid "), "uuid"))
        .when(F.col("kind") == "unresolvable", F.concat(F.lit("no document declares uuid "), "uuid"))
        .when(F.col("kind") == "conflict", F.concat(F.lit("the path "), "href", F.lit(" and uuid "), "uuid", F.lit(" of "), target, F.lit(" disagree")))
        .otherwise(F.concat("href", F.lit(" -> "), F.coalesce("new_href", F.lit(""))))
    )
    found = documents.findings(rows.where("scoped"), "integrity", F.col("kind"), detail, line=F.col("line"), href=F.col("href"), uuid=F.col("uuid"), start=F.col("s"))
    silent = documents.scoped(docs.where("link_ignored").select("path"), scope).where("scoped")
    found = found.unionByName(documents.findings(silent, "integrity", "ignored_links", F.lit("its links are left as they are; it is still a target")))
    edits = rows.where("scoped AND kind = 'repair'").select("path", "s", "e", tokens.robust_link(F.col("text"), F.col("new_href"), F.col("uuid"), F.col("attrs")).alias("r"))
    return Repair(found, edits, rows.where("NOT scoped").groupBy("path").agg(F.count("*").alias("n")), tree.docs, docs)
