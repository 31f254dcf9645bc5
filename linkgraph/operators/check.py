"""All axes of a tree's integrity in one report, and its verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators import documents, repair, robustify
from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut

#: Kinds that make a tree unsound, and kinds that make it less strict than it could be.
BROKEN = ("repair", "conflict", "unresolvable", "ambiguous", "invalid_frontmatter")
LOOSE = ("robustify", "invalid_frontmatter")


@dataclass(frozen=True)
class Check:
    findings: DataFrame
    repair: repair.Repair
    robustify: robustify.Robustify

    def counts(self) -> DataFrame:
        return self.findings.groupBy("axis", "kind").agg(F.count("*").alias("n"))

    def verdict(self) -> DataFrame:
        """broken, loose, code: 2 if anything is broken, 3 if anything is loose, else 0."""
        broken = F.count_if((F.col("axis") == "integrity") & F.col("kind").isin(*BROKEN))
        loose = F.count_if((F.col("axis") == "strict") & F.col("kind").isin(*LOOSE))
        return self.findings.agg(broken.alias("broken"), loose.alias("loose")).withColumn("code", F.when(F.col("broken") > 0, 2).when(F.col("loose") > 0, 3).otherwise(0))

    def report(self) -> DataFrame:
        """axis, finding: each finding as JSON."""
        row = F.to_json(F.struct("kind", "path", "line", "href", "detail"))
        return self.findings.select("axis", row.alias("finding"))


def check(tree: Tree, options: Options = Options(), scope: DataFrame | None = None) -> Check:
    """Repair and robustify over the same prepared documents; nothing is written and no frontmatter created."""
    docs = cut(documents.prepared(tree, options, ("robust", "plain", "strays")))
    one, two = repair.plan(tree, options, scope, docs), robustify.plan(tree, options, scope, docs)
    invalid = documents.scoped(documents.invalid_documents(docs), scope).where("scoped")
    found = one.findings.unionByName(two.findings).unionByName(documents.findings(invalid, "integrity", "invalid_frontmatter", F.lit(documents.INVALID)))
    return Check(found, one, two)
