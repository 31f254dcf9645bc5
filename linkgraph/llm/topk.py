"""Exact top-k by inner product with Fagin's threshold algorithm, in blocks.

Queries are broadcast, a block of bounded size at a time; candidates stay where they lie and are
read in blocks.  A block's vectors are sorted along each dimension, each query reads these lists
from the end that suits its component's sign, scores what it meets, and stops once no unread
vector can reach the k-th score that its task has seen so far, in this block or in those before.
The tasks' results are then merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block; bytes of the queries that are broadcast at once.
BLOCK, QUERY_BYTES = 4096, 16_000_000
#: Quantised components from here on are refused: sums of their products might not fit into 64 bits.
LARGEST = 2**26
#: List entries of each dimension that a query reads first; then twice as many each time.
DEPTH = 8


class Lists:
    """A block's vectors (n, d) of whole numbers, with the order of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.read = 0

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but own, best first, ties to the smaller id; those below floor may be left out."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        # Sums of products up to 2 ** 53 are exact in float64, and fast.
        kind = np.float64 if float(np.abs(query).astype(float) @ np.abs(self.vectors).max(axis=0, initial=0).astype(float)) < 2.0**53 else np.int64
        values, weights = self._as(kind), query.astype(kind)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        depth, step = 0, DEPTH
        while depth < n:
            end = min(n, depth + step)
            if len(used):
                places = np.where(query[used] > 0, n - 1 - np.arange(depth, end)[:, None], np.arange(depth, end)[:, None])
                met = self.order[places, used].ravel()
            else:
                met, end = np.arange(n), n
            fresh = np.zeros(n, dtype=bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            self.read += len(new)
            new_scores = values[new] @ weights
            good = self.ids[new] != own
            rows, scores = np.concatenate((rows, new[good])), np.concatenate((scores, new_scores[good]))
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            depth, step = end, 2 * step
            if depth < n:
                edge = self.order[np.where(query[used] > 0, n - depth, depth - 1), used]
                bound = values[edge, used] @ weights[used]  # the most that an unread vector can score
                if bound < floor or len(rows) >= k and scores.min() > bound:
                    break
        best = np.lexsort((rows, -scores))[:k]
        return self.ids[rows[best]], scores[best].astype(np.int64)

    def _as(self, kind: type) -> np.ndarray:
        if kind is np.int64:
            return self.vectors
        if not hasattr(self, "floats"):
            self.floats = self.vectors.astype(np.float64)
        return self.floats


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as double; null where the vector is null, empty or holds null or non-finite components."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) * 256 < LARGEST)
    refused = F.raise_error(F.lit(f"a component is {LARGEST} or more when multiplied by 256: its products would not fit"))
    return F.when((F.size(vector) > 0) & finite, F.when(small, whole).otherwise(refused))


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k best of each query.

    queries: which rows are queries; every row is a candidate, but for those with the query's
    id.  Rows with a null id or an unusable vector take no part; vectors of different lengths
    are never compared.  An id that is a query more than once counts with its least vector;
    repeated candidate rows each count.  Fewer rows are returned where there are fewer
    candidates; an empty table gives an empty result.  Other columns are not looked at.  Scores
    are sums of 64-bit integers: quantised components from LARGEST on are refused.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col]).alias("v"), queries.alias("asks")).where("id is not null and v is not null")
    candidates = rows.select("id", "v")
    wanted = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    size = wanted.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // QUERY_BYTES)) if size > QUERY_BYTES else 1
    found = None
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        asked = vectors.sparkSession.sparkContext.broadcast({d: (ids, matrix) for d, ids, matrix in _by_length(some)})
        now = candidates.mapInArrow(_searched(asked, k), "query_id long, vec_id long, score long")
        found = now if found is None else found.unionByName(now)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors of the rows (id, v) of each length."""
    lengths = pc.list_value_length(rows["v"]).to_numpy()
    for d in np.unique(lengths).tolist():
        some = rows.filter(pa.array(lengths == d))
        column = some["v"].combine_chunks() if isinstance(some, pa.Table) else some["v"]
        yield d, some["id"].to_numpy(), column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _searched(asked: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best candidates of a task, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids) for d, (ids, _) in asked.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in best}

        def search(d: int) -> None:
            ids, matrix = (np.concatenate(x) for x in zip(*held[d], strict=True))
            held[d] = []
            lists = Lists(ids, matrix)
            for n, (own, query) in enumerate(zip(*asked.value[d], strict=True)):
                known, scores = best[d][n]
                more, more_scores = lists.top(query, own, k, scores[-1] if len(scores) == k else -np.inf)
                both, both_scores = np.concatenate((known, more)), np.concatenate((scores, more_scores))
                order = np.lexsort((both, -both_scores))[:k]
                best[d][n] = both[order], both_scores[order]

        for batch in batches:
            for d, ids, matrix in _by_length(batch):
                if d in held:
                    for at in range(0, len(ids), BLOCK):
                        held[d].append((ids[at : at + BLOCK], matrix[at : at + BLOCK]))
                        if sum(len(x[0]) for x in held[d]) >= BLOCK:
                            search(d)
        for d, (ids, _) in asked.value.items():
            if held[d]:
                search(d)
            counts = [len(x[0]) for x in best[d]]
            columns = (np.repeat(ids, counts), *(np.concatenate(x) for x in zip(*best[d], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run
