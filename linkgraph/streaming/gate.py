"""An extension: a check of each micro-batch of changed documents against the tree they belong to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from linkgraph.operators.check import Check, check
from linkgraph.operators.documents import Options, Tree


def gated(changes: DataFrame, tree: Callable[[], Tree], take: Callable[[Check, int], None], options: Options = Options()) -> DataStreamWriter:
    """changes: a stream of (path, content).  For each batch, tree() is checked with the changed documents in place, within their scope."""

    def each(batch: DataFrame, number: int) -> None:
        now = tree()
        fresh = batch.select("path", "content").dropDuplicates(["path"])
        docs = now.docs.select("path", "content").join(fresh, "path", "left_anti").unionByName(fresh)
        take(check(Tree.of(docs, now.entries, options), options, fresh.select("path")), number)

    return changes.writeStream.foreachBatch(each)
