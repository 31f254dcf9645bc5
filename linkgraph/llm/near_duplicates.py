"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Under each permutation of the hash values both the smallest and the largest of a set are
kept, so that every evaluation gives two values of the signature.  Bands of these values put
documents into buckets; in a bucket every document is compared with one pivot, the one that
shares its buckets with the most documents, so that a bucket of n documents gives n - 1 pairs
and the buckets of a group mostly have the same pivot.

That alone would miss x ~ y where x isn't similar to the pivot r.  With S(x) the symmetric
difference of x and r, |x ^ y| = |S(x) ^ S(y)|, and J(x, y) >= t means
|x ^ y| <= d * (|x| + |y|) with d = (1 - t) / (1 + t).  As |S(x)| > d * (|x| + |r|), S(x) and
S(y) share elements, and so do prefixes of both under any common order.  Such pairs, and only
they, are found by a join on the prefixes' elements and then compared.  So no link between two
documents of one bucket is lost, though their pairs are not all made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm import _shared, _text

#: Words of a shingle, unless told otherwise.
WORDS = 4
#: Least similarity, as a fraction: 4 / 5.
TIMES, OF = 4, 5
#: Bands and values of a band; each permutation gives two values.  A pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 28, 4e-7.
BANDS, ROWS = 28, 4
PERMUTATIONS = BANDS * ROWS // 2

_rng = np.random.default_rng(4_711)
_FLIP = _rng.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint32) | np.uint32(1)
_MERGE = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(part: _text.Slice, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document, hashed; of fewer than k words, the whole sequence as one."""
    starts, ends, first = part.words(_text.NON_SPACE)
    words = part.word_hashes(starts, ends, lower=True)
    grams, at = _text.ngrams(words, first, k)
    cut = np.searchsorted(at, first)
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for n in range(1, k):
        if len(few := np.flatnonzero(np.diff(first) == n)):
            runs = _text.run_hashes(words, n)
            for d in few.tolist():
                out[d] = runs[first[d] : first[d] + 1]
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima under all permutations, then the maxima."""
    values = ((shingles >> _text.U64(32)).astype(np.uint32) ^ _FLIP) * _TIMES
    return np.concatenate((values.min(axis=1), values.max(axis=1)))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; equal where all values of the band are."""
    merged = (signatures.reshape(-1, BANDS, ROWS).astype(np.uint64) * _MERGE).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _text.U64(0x9E3779B97F4A7C15)
    return _text.mix(merged).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch.column(1)):
            sets = shingle_sets(part, words)
            full = [d for d, x in enumerate(sets) if len(x)]
            keys = band_keys(np.stack([signature(sets[d]) for d in full])) if full else np.zeros((0, BANDS), np.int64)
            bands: list[np.ndarray | None] = [None] * len(sets)
            for d, x in zip(full, keys, strict=True):
                bands[d] = x
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.first, len(part)), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n", "content", "bands"],
            )


def _similar(a: int, b: int, shared: int) -> bool:
    return OF * shared >= TIMES * (a + b - shared)


def _compare(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Of each pair (r, x) with texts: whether they are linked, and S(x), where what only r has is inverted.

    reach_x: how many elements of S(x), under any common order, suffice to meet any y if x isn't
    linked to r; reach_y: how many suffice to be met by an x that isn't linked to r.
    """
    for batch in batches:
        columns: dict[str, list] = {k: [] for k in ("r", "x", "linked", "n", "size", "reach_x", "reach_y", "tokens")}
        sets: dict[int, np.ndarray] = {}
        for name in ("text_r", "text_x"):
            ids = batch.column(name[-1]).to_numpy()
            at = np.sort(np.unique(ids, return_index=True)[1])
            texts = batch.column(name).take(pa.array(at))
            for part in _text.slices(texts):
                for k, x in enumerate(shingle_sets(part, words)):
                    sets.setdefault((name, int(ids[at[part.first + k]])), x)
        for row, (r, x) in enumerate(zip(batch.column("r").to_pylist(), batch.column("x").to_pylist(), strict=True)):
            a, b = sets["text_r", r], sets["text_x", x]
            own, lost = np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)
            size, linked = len(own) + len(lost), _similar(len(a), len(b), len(b) - len(own))
            # Doubled, and times OF + TIMES, so that they are whole numbers.
            low_x = (OF + TIMES) * size - (OF - TIMES) * (len(a) + len(b))
            low_y = (OF + TIMES) * size + (OF - TIMES) * (len(a) - len(b))
            reach = [max(0, min(size, size + 1 - -(-low // (2 * (OF + TIMES))))) for low in (low_x, low_y)]
            if linked:
                reach[0] = 0
            for name, value in zip(columns, (r, x, linked, len(b), size, *reach, np.concatenate((own, ~lost)).view(np.int64)), strict=True):
                columns[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[k], kind) for k, kind in (("r", pa.int64()), ("x", pa.int64()), ("linked", pa.bool_()), ("n", pa.int64()), ("size", pa.int64()), ("reach_x", pa.int32()), ("reach_y", pa.int32()), ("tokens", pa.list_(pa.int64())))], list(columns)
        )


_COMPARED = "r long, x long, linked boolean, n long, size long, reach_x int, reach_y int, tokens array<long>"


def _compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (r, x) with both texts brought together."""
    one = texts.select(F.col("id").alias("x"), F.col("text").alias("text_x"))
    other = texts.select(F.col("id").alias("r"), F.col("text").alias("text_r"))
    # Merge joins at every size: neither side has a bound.
    return pairs.join(one.hint("merge"), "x").join(other.hint("merge"), "r").select("r", "x", "text_r", "text_x").mapInArrow(lambda batches: _compare(batches, words), _COMPARED)


def _missed(stars: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Pairs that aren't linked by their pivot and may be similar, as (r, x) with r < x, and the tables that they come from."""
    # A table of its own, so that the join with it can split the rows of a pivot of many documents.
    open_pivots = _shared.written(stars.groupBy("r").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("unlinked")).where("n > 1 AND unlinked > 0").select("r"), "pivots")
    found = stars.join(open_pivots, "r")
    # The order of the elements: those that fewer documents differ in from the pivot come first.
    each = found.select("r", "x", F.explode("tokens").alias("token"))
    often = each.groupBy("r", "token").agg(F.count("*").alias("often"))
    order = each.join(often, ["r", "token"]).groupBy("r", "x").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("order"))
    rows = _shared.written(found.drop("tokens").join(order, ["r", "x"]).select("r", "x", "n", "size", "linked", "reach_x", "reach_y", F.slice("order.token", F.lit(1), F.greatest("reach_x", "reach_y")).alias("start")), "orders")

    def part(length: str, of: DataFrame, mark: str) -> DataFrame:
        return of.select("r", *(F.col(k).alias(f"{k}{mark}") for k in ("x", "n", "size", "linked")), F.posexplode(F.slice("start", F.lit(1), F.col(length))).alias(f"at{mark}", "token"))

    left, right = part("reach_x", rows.where("NOT linked"), "1"), part("reach_y", rows, "2")
    # Twice the least number of shared elements, times OF + TIMES.
    least = F.lit(OF + TIMES) * (F.col("size1") + F.col("size2")) - F.lit(OF - TIMES) * (F.col("n1") + F.col("n2"))
    reached = [F.lit(2 * (OF + TIMES)) * (F.col(f"size{k}") - F.col(f"at{k}")) >= least for k in "12"]
    close = (F.lit(TIMES) * F.greatest("n1", "n2") <= F.lit(OF) * F.least("n1", "n2")) & reached[0] & reached[1]
    once = (F.col("x1") < F.col("x2")) | (F.col("linked2") & (F.col("x1") != F.col("x2")))
    a, b = left.alias("a"), right.alias("b")
    found = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.token") == F.col("b.token")) & once & close)
    return found.select(F.least("x1", "x2").alias("r"), F.greatest("x1", "x2").alias("x")).distinct(), (open_pivots, rows)


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each end of an edge (a long, b long) reaches.

    Large-star and small-star steps by turns, each round's edges written to the shared folder,
    until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    mark: Column = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    now = _shared.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    was = None
    while (seen := now.agg(mark.alias("m")).first().m) != was:
        was = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.low").alias("v")).where("u <> v").distinct()
        before, now = now, _shared.written(small, "edges")
        _shared.discard(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def find(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles long, component_id, kept boolean of every document.

    A document's set: the distinct shingles of ``words`` words of its whole text, with A-Z in lower
    case; with fewer words, all of them as one; null and empty texts have none and are linked
    with nothing.  Documents at TIMES / OF or more are linked, on the whole sets; component_id
    is the smallest id that links reach, kept says that it is the document's own.  Documents of
    equal sets are one node from the start.  Rows of the same id are one document of several
    texts; rows with a null id are kept, without a component.  Ids are whole numbers; other
    columns are not looked at; an empty table gives an empty result.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    signed = _shared.written(source.mapInArrow(lambda batches: _sign(batches, words), "id long, n long, content binary, bands array<long>"), "signatures")
    named = signed.where("n > 0 AND id IS NOT NULL")
    # Sets of several ids.  A table of its own, so that joins with it can split the rows of a set of many copies.
    classes = named.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("content", "first")
    classes = _shared.written(classes, "classes")
    # Of copies of a set, the one with the smallest id goes on; a set of any number of copies is one row of each task.
    heads = named.groupBy("content").agg(F.min(F.struct("id", "bands")).alias("h"))
    keys = heads.select(F.col("h.id").alias("node"), F.explode("h.bands").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = _shared.written(keys.join(full, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = members.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best"))
    pivots = pivots.select("key", (-F.col("best.minus")).alias("r"))
    pairs = _shared.written(members.join(pivots, "key").where("node <> r").select("r", F.col("node").alias("x")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("r", "x")).alias("id")).distinct()
    texts = _shared.written(_shared.narrowed(source, ids, "id").join(ids.hint("merge"), "id", "left_semi"), "texts")
    stars = _shared.written(_compared(pairs, texts, words), "stars")
    missed, orders = _missed(stars)
    missed = _shared.written(missed, "pairs")
    more = _compared(missed, texts, words)
    edges = stars.where("linked").select(F.col("r").alias("a"), F.col("x").alias("b")).unionByName(more.where("linked").select(F.col("r").alias("a"), F.col("x").alias("b")))
    # An id with several texts ties their classes together.
    repeated = named.groupBy("id").agg(F.min("content").alias("c"), F.max("content").alias("d")).where("c <> d").select("id")
    tied = named.join(repeated, "id", "left_semi").select("id", "content").distinct().join(classes, "content").select(F.col("id").alias("a"), F.col("first").alias("b"))
    edges = edges.unionByName(tied)
    found = components(edges)
    _shared.discard(members, pairs, texts, stars, missed, *orders)
    owned = signed.select("id", "n", "content").join(classes, "content", "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce(F.least("first", "id"), "id")).otherwise(F.col("id")))
    joined = owned.join(found.withColumnRenamed("id", "node"), "node", "left")
    component = F.coalesce("component", "node")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that find keeps, with all their columns; of repeated rows of a kept id, one."""
    found = find(docs.select(id_col, text_col), words, id_col, text_col)
    lost = found.where("NOT kept").select(F.col(id_col).alias("lost")).distinct()
    rows = docs.join(lost, docs[id_col].eqNullSafe(lost["lost"]), "left_anti")
    if docs.where(docs[id_col].isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        null, some = rows.where(rows[id_col].isNull()), rows.where(rows[id_col].isNotNull())
        return some.dropDuplicates([id_col]).unionByName(null)
    return rows
