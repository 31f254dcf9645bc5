"""Benchmark passages in documents, by winnowing.

From every window of W consecutive k-gram hashes the smallest is kept (the rightmost of equal
ones).  Two texts that share W + k - 1 words choose the same k-gram there, so the join of both
sides' fingerprints misses no such span.  Around each joined fingerprint the whole windows are
then compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm import _shared, _text

#: Words of a window; words of a k-gram; k-grams from which one is kept.
WINDOW, K = 10, 5
SPAN = WINDOW - K + 1
#: Characters of benchmark items that are broadcast at once; more are taken in slices of this size.
BROADCAST_CHARS = 16_000_000
#: Most words of a piece of an item, where items are taken in slices.
PIECE = 1_000


def winnow(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of the kept k-grams. at: the word at which each begins; runs without a gap lie in one document."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, which = hashes[:n].copy(), np.arange(n)
    for j in range(1, SPAN):
        lower = hashes[j : j + n] <= least
        np.copyto(least, hashes[j : j + n], where=lower)
        which[lower] = np.flatnonzero(lower) + j
    kept = np.zeros(len(hashes), dtype=bool)
    kept[which[at[SPAN - 1 :] - at[:n] == SPAN - 1]] = True
    return np.flatnonzero(kept)


class Words:
    """The words of some documents, by hashes of two families."""

    def __init__(self, part: _text.Slice) -> None:
        starts, ends, self.first = part.words(_text.ALNUM)
        self.hashes = [part.word_hashes(starts, ends, lower=True, family=k) for k in (0, 1)]

    def __len__(self) -> int:
        return len(self.hashes[0])

    def windows(self, size: int, starts: np.ndarray) -> np.ndarray:
        """Two independent hashes of the windows of size words, as one array of pairs."""
        out = np.empty(len(starts), dtype=[("a", np.uint64), ("b", np.uint64)])
        out["a"], out["b"] = (_text.run_hashes(x, size, k)[starts] for k, x in enumerate(self.hashes))
        return out

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return _text.ngrams(self.hashes[0], self.first, size)


@dataclass
class Lookup:
    """Windows of one length: sorted hashes, and the items of each."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray) -> Lookup:
        order = np.lexsort((items, hashes["b"], hashes["a"]))
        hashes, items = hashes[order], items[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
        return cls(hashes[new], np.append(np.flatnonzero(new), len(items)), items)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are known, and their places."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes["a"], hashes["a"]), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes["a"][place] == hashes["a"])
        place = place[rows]
        while len(bad := np.flatnonzero(self.hashes["b"][place] != hashes["b"][rows])):  # first hashes alike
            ahead = np.minimum(place[bad] + 1, len(self.hashes) - 1)
            lost = (ahead == place[bad]) | (self.hashes["a"][ahead] != hashes["a"][rows[bad]])
            place[bad] = ahead
            rows, place = np.delete(rows, bad[lost]), np.delete(place, bad[lost])
        return rows, place


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.names = [x[0] for x in items]
        prints, windows, owners, short = [np.zeros(0, np.uint64)], [], [], {}
        at = 0
        for part in _text.slices(pa.array([x[1] for x in items], pa.string())):
            words = Words(part)
            first = words.first
            grams, places = words.grams(K)
            prints.append(grams[winnow(grams, places)])
            _, places = words.grams(WINDOW)
            windows.append(words.windows(WINDOW, places))
            owners.append(at + np.searchsorted(first, places, "right") - 1)
            for k in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WINDOW)):
                size = int(first[k + 1] - first[k])
                short.setdefault(size, []).append((words.windows(size, first[k : k + 1]), at + k))
            at += len(part)
        self.prints = np.unique(np.concatenate(prints))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.prints & _text.U64(0xFFFFF)] = True
        self.whole = Lookup.of(np.concatenate(windows), np.concatenate(owners)) if windows else Lookup.of(np.zeros(0, [("a", np.uint64), ("b", np.uint64)]), np.zeros(0, np.int64))
        self.short = {size: Lookup.of(np.concatenate([x[0] for x in found]), np.array([x[1] for x in found])) for size, found in short.items()}

    def search(self, part: _text.Slice) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[object]]]]:
        """Number of words of each document; for those with occurrences, word intervals without overlap and items."""
        words = Words(part)
        first = words.first
        grams, at = words.grams(K)
        kept = winnow(grams, at)
        kept = kept[self.sieve[grams[kept] & _text.U64(0xFFFFF)]]
        joined = at[kept[np.isin(grams[kept], self.prints)]]
        begin = np.unique((joined[:, None] + np.arange(K - WINDOW, 1)).ravel())
        begin = begin[(begin >= 0) & (begin + WINDOW <= len(words))]
        doc = np.searchsorted(first, begin, "right") - 1
        begin = begin[begin + WINDOW <= first[doc + 1]]
        found = [(begin[rows], WINDOW, self.whole, place) for rows, place in [self.whole.find(words.windows(WINDOW, begin))]]
        for size, lookup in self.short.items():
            _, places = words.grams(size)
            rows, place = lookup.find(words.windows(size, places))
            found.append((places[rows], size, lookup, place))
        hits: dict[int, tuple[list[tuple[int, int]], set[object]]] = {}
        for places, size, lookup, place in found:
            for p, d, k in zip(places.tolist(), (np.searchsorted(first, places, "right") - 1).tolist(), place.tolist(), strict=True):
                spans, names = hits.setdefault(d, ([], set()))
                spans.append((p - int(first[d]), p - int(first[d]) + size))
                names.update(self.names[x] for x in lookup.items[lookup.first[k] : lookup.first[k + 1]])
        return np.diff(first), {d: (merged(spans), names) for d, (spans, names) in hits.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_HITS = "array<struct<s:int,e:int>>"
_HITS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of more than PIECE words as several of the same name, which together have the same windows."""
    for batch in batches:
        for part in _text.slices(batch.column(1)):
            starts, ends, first = part.words(_text.ALNUM)
            owners, texts = [], []
            for d, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                for at in range(low, max(low + 1, high - WINDOW + 1), PIECE - WINDOW + 1):
                    some = slice(at, min(at + PIECE, high))
                    owners.append(part.first + d)
                    texts.append(b" ".join(part.data[s:e].tobytes() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(texts, pa.string())], ["name", "text"])


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Callable[[], Broadcast]]:
    """What broadcasts each slice of the items; a slice is collected only when its turn comes.

    Where all items are too many for one, they are cut into pieces, and these into so many slices
    that none is larger than BROADCAST_CHARS, or than two pieces, should their words be that long.
    """
    items = benchmark.select(benchmark[item_col].cast("string").alias("name"), benchmark[text_col].alias("text")).dropna(subset=["text"])
    chars, passes = F.char_length("text"), 1
    if items.agg(F.coalesce(F.sum(chars), F.lit(0))).first()[0] > BROADCAST_CHARS:
        items = _shared.written(items.mapInArrow(_pieces, "name string, text string").distinct(), "items")
        size, longest = items.agg(F.coalesce(F.sum(chars), F.lit(0)), F.coalesce(F.max(chars), F.lit(0))).first()
        passes = max(1, -(-2 * size // BROADCAST_CHARS))
        most = F.max("chars").alias("most")
        while (items.groupBy(_slice(passes)).agg(F.sum(chars).alias("chars")).agg(most).first().most or 0) > max(BROADCAST_CHARS, 2 * longest):
            passes *= 2
    for k in range(passes):
        part = items.where(_slice(passes) == k) if passes > 1 else items
        yield lambda part=part: benchmark.sparkSession.sparkContext.broadcast(Index([(x.name, x.text) for x in part.collect()]))


def _slice(passes: int) -> Column:
    return F.pmod(F.xxhash64("name", "text"), F.lit(passes))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without any occurrence of an item's window, with all their columns."""
    place = docs.columns.index(text_col)

    def search(index: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _text.slices(batch.column(place)):
                    hits = index.value.search(part)[1]
                    yield batch.slice(part.first, len(part)).filter(pa.array([d not in hits for d in range(len(part))], pa.bool_()))

        return run

    for k, make in enumerate(_indexes(benchmark, item_col, item_text_col)):
        docs = (_shared.written(docs, "contamination") if k else docs).mapInArrow(search(make()), docs.schema)
    return docs


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_words long, hits array<struct<s int, e int>> (word intervals), items array<string> (sorted).

    An item's windows are its runs of WINDOW words, or all its words where it has fewer; an item
    without words or with null text has none.  A null or empty document has no words.  Items of
    the same name count once, and so do all without a name, as a null at the end of items, which
    no digest of names takes in; repeated documents stay; other columns are not looked at.  Whole
    texts are searched.  Items go to the executors in slices of at most BROADCAST_CHARS, each a
    pass of its own whose rows are written to the shared folder; no document is shuffled.
    """
    key = docs.schema[id_col].dataType.simpleString()
    indexes = list(_indexes(benchmark, item_col, item_text_col))
    state = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for k, make in enumerate(indexes):
        index, last = make(), k == len(indexes) - 1
        if k:
            state = _shared.written(state, "contamination")
        state = state.mapInArrow(_pass(index, first=not k, text=not last or with_text), f"key {key}, {'' if last and not with_text else 'text string, '}n_words long, hits {_HITS}, items array<string>")
    return state.withColumnRenamed("key", id_col)


def _pass(index, first: bool, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column(1)):
                old = batch.slice(part.first, len(part))
                counts, found = index.value.search(part)
                hits, items = [[]] * len(part), [[]] * len(part)
                if not first:
                    hits, items = old.column(3).to_pylist(), old.column(4).to_pylist()
                for d, (spans, names) in found.items():
                    hits[d] = [{"s": s, "e": e} for s, e in merged([*((x["s"], x["e"]) for x in hits[d]), *spans])]
                    items[d] = sorted({*items[d], *names}, key=lambda x: (x is None, x))
                columns = {"key": old.column(0)} | ({"text": old.column(1)} if text else {}) | {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, _HITS_ARROW), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From scan: id_col, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))

