"""Edits of documents: (path, s, e, r) replace the characters from s to e by r."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS = "path string, s int, e int, r string"


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array<struct<s, e, r>>, disjoint, in any order) applied."""

    def step(state: Column, x: Column) -> Column:
        return F.struct(x["e"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), x["r"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(edits), zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def rewrites(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """path, new_content of every document that edits change."""
    each = edits.groupBy("path").agg(F.collect_list(F.struct("s", "e", "r")).alias("edits"))
    return docs.select("path", "content").join(each, "path").select("path", "content", spliced(F.col("content"), F.col("edits")).alias("new_content")).where("new_content <> content").drop("content")
