"""Passages that repeat an earlier document, word for word, by Aho-Corasick automata.

A window is WINDOW consecutive words.  Winnowing picks a k-gram from every run of windows, and
equal windows pick the same one; a k-gram that several documents have marks, in the document
with the smallest id that has it, passages: the windows around each of its places there, each
distinct window once, in pieces of bounded length.

Documents are dealt into shards.  The passages that a shard's documents ask for by their marked
k-grams are compiled into automata, a bounded number of characters at a time, over the
beginnings of the marked k-grams; every document of the shard is streamed through them, and
each place found is extended to the longest common run and compared byte by byte.  Runs of
WINDOW words or more are repeats.  A window whose marked k-gram has an earlier document, but
that itself is in none of the passages, isn't in that document at all; such windows are grouped
by their hash, those of several documents mark further passages, and the documents that hold
them are streamed once more.  Documents without a shared marked k-gram repeat nothing, for a
repeated window would be marked by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm import _shared, _text

#: Words of a window and of a marked k-gram; k-grams from which one is marked; words of a k-gram that an automaton looks for.
WINDOW, K, KEY = 50, 16, 8
SPAN = WINDOW - K + 1
#: Most words of a passage, before its last window; longer ones are cut into overlapping pieces.
PIECE = 400
#: Characters of the documents of a shard, and of the passages of one automaton.
SHARD_CHARS, PASSAGE_CHARS = 1 << 20, 1 << 21
#: Places of a key that are extended without a look at the words around them first.
FEW = 8
#: Places of keys in a text that are held at once.
HITS = 100_000
_EMPTY = hashlib.sha256(b"").digest()


def marks(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of SPAN consecutive k-grams, its first k-gram and its smallest (the rightmost of equal ones), as indexes."""
    if len(grams) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, which, size = grams, np.arange(len(grams)), 1
    while size < SPAN:
        ahead = min(size, SPAN - size)
        later = least[ahead:] <= least[:-ahead]
        least, which = np.where(later, least[ahead:], least[:-ahead]), np.where(later, which[ahead:], which[:-ahead])
        size += ahead
    whole = np.flatnonzero(at[SPAN - 1 :] - at[: len(which)] == SPAN - 1)
    return whole, which[whole]


class Texts:
    """Some whole texts side by side: hashes of all words, bytes with a space after each word, each text's first word."""

    def __init__(self, part: _text.Slice) -> None:
        starts, ends, self.first = part.words(_text.NON_SPACE)
        self.hashes = part.word_hashes(starts, ends, lower=False)
        sizes = ends - starts + 1
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        small = np.int32 if len(part.data) < 1 << 30 else np.int64
        at = np.arange(self.begins[-1], dtype=small) + np.repeat((starts - self.begins[:-1]).astype(small), sizes)
        self.bytes = part.data.take(at, mode="clip")
        self.bytes[self.begins[1:] - 1] = 32

    def __len__(self) -> int:
        return len(self.first) - 1

    def raw(self, start: int, end: int) -> bytes:
        """The words joined by single spaces."""
        return self.bytes[self.begins[start] : max(self.begins[start], self.begins[end] - 1)].tobytes()

    def kept(self, covered: np.ndarray) -> Iterator[bytes]:
        """The digest of each text's words that aren't covered, joined by single spaces."""
        stays = np.repeat(~covered, np.diff(self.begins))
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            s, e = self.begins[a], self.begins[b]
            yield hashlib.sha256(self.bytes[s:e][stays[s:e]][:-1]).digest()

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows' first words, and their marked k-grams: hash and first word."""
        grams, at = _text.ngrams(self.hashes, self.first, K)
        whole, which = marks(grams, at)
        return at[whole], grams[which].view(np.int64), at[which]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that begin at these words."""
        return tuple(_text.run_hashes(self.hashes, WINDOW, family)[at].view(np.int64) for family in (0, 1))


def _lists(items: pa.StructArray, owner: np.ndarray, n: int) -> pa.ListArray:
    """items, whose owners ascend, as one list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), items)


def _structs(**columns: tuple[np.ndarray, pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x).cast(kind) for x, kind in columns.values()], list(columns))


_PRINTS = "id long, key long, n long, whole binary, marks array<struct<h:long,p:int>>"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch.column(2)):
            texts = Texts(part)
            _, grams, places = texts.marks()
            places, where = np.unique(places, return_index=True)
            owner = texts.text_of(places)
            found = _lists(_structs(h=(grams[where], pa.int64()), p=(places - texts.first[owner], pa.int32())), owner, len(texts))
            whole = pa.array(texts.kept(np.zeros(len(texts.hashes), bool)), pa.binary())
            rows = batch.slice(part.first, len(part))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(texts.first), pa.int64()), whole, found], ["id", "key", "n", "whole", "marks"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Automaton:
    """Passages, compiled to find where other texts repeat them. owners: the id of each passage's document."""

    def __init__(self, owners: np.ndarray, passages: pa.Array) -> None:
        self.owners = owners
        self.texts = Texts(next(_text.slices(passages, 1 << 62)))
        first = self.texts.first
        # All passages one after another, with gaps that equal no word.
        size = len(self.texts.hashes) + WINDOW * (len(first))
        self.line = np.zeros(size, np.uint64)
        self.line[np.arange(len(self.texts.hashes)) + WINDOW * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))] = self.texts.hashes
        # The marked k-grams of the passages' windows; each of them is a beginning that is looked for.
        at = np.unique(self.texts.marks()[2])
        code, passage = self._code(self.texts.hashes), self.texts.text_of(at)
        places: dict[str, list[int]] = {}
        for k in at.tolist():
            places.setdefault(code[2 * k : 2 * (k + KEY)], []).append(k)
        self.passage_of = dict(zip(at.tolist(), passage.tolist(), strict=True))
        self.found = ahocorasick.Automaton()
        for key, where in places.items():
            self.found.add_word(key, np.array(where) if len(where) > FEW else where)
        if places:
            self.found.make_automaton()

    @staticmethod
    def _code(hashes: np.ndarray) -> str:
        """Two letters a word, of two alphabets, so that a key is found at whole words only."""
        out = np.empty(2 * len(hashes), np.uint8)
        out[::2], out[1::2] = (hashes & _text.U64(31)) + _text.U64(32), ((hashes >> _text.U64(5)) & _text.U64(31)) + _text.U64(64)
        return out.tobytes().decode("ascii")

    def _near(self, hashes: np.ndarray, places: np.ndarray) -> list[int]:
        """Those of places whose common run with the text, up to WINDOW words on each side, has WINDOW words."""
        around = np.arange(-WINDOW, WINDOW)
        out: list[int] = []
        for i in range(0, len(places), 10_000):
            some = places[i : i + 10_000]
            passages = np.array([self.passage_of[x] for x in some.tolist()])
            wrong = self.line[(some + WINDOW * (1 + passages))[:, None] + around] != hashes
            back, ahead = (np.where(x.any(axis=1), x.argmax(axis=1), WINDOW) for x in (wrong[:, WINDOW - 1 :: -1], wrong[:, WINDOW:]))
            out += some[back + ahead >= WINDOW].tolist()
        return out

    def _runs(self, texts: Texts, start: int, end: int, place: int) -> Iterator[tuple[int, int]]:
        """The text's words from start to end as runs that are the passages' words from place, compared byte by byte."""
        if texts.raw(start, end) == self.texts.raw(place, place + end - start):
            yield start, end
            return
        same = [texts.raw(start + i, start + i + 1) == self.texts.raw(place + i, place + i + 1) for i in range(end - start)]
        edges = np.flatnonzero(np.diff(np.array([False, *same, False]).astype(np.int8)))
        yield from ((start + a, start + b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= WINDOW)

    def runs(self, ids: np.ndarray, texts: Texts) -> list[tuple[int, int]]:
        """Longest runs of WINDOW words or more that are in a passage of a smaller id than the text's, as intervals of the texts' words."""
        if not len(self.found):
            return []
        done: dict[tuple[int, int], int] = {}
        out: list[tuple[int, int]] = []
        every = self.found.iter(self._code(texts.hashes))
        while hits := list(islice(every, HITS)):
            starts = (np.array([x[0] for x in hits], np.int64) + 1) // 2 - KEY
            done = {k: v for k, v in done.items() if v > starts[0]}
            self._extend(ids, texts, starts, [x[1] for x in hits], done, out)
        return out

    def _extend(self, ids: np.ndarray, texts: Texts, starts: np.ndarray, hits: list, done: dict[tuple[int, int], int], out: list[tuple[int, int]]) -> None:
        """Runs around starts, where keys with the places hits were found. done: up to where each pair of passage and shift is extended."""
        docs = texts.text_of(starts)
        hashes, other, first = texts.hashes, self.texts.hashes, self.texts.first.tolist()
        bounds = zip(starts.tolist(), texts.first[docs].tolist(), texts.first[docs + 1].tolist(), ids[docs].tolist(), hits, strict=True)
        for at, low, high, id, where in bounds:
            if at + KEY > high:
                continue
            if isinstance(where, np.ndarray):
                around = np.ones(2 * WINDOW, np.uint64)
                a, b = max(low, at - WINDOW), min(high, at + WINDOW)
                around[a - at + WINDOW : b - at + WINDOW] = hashes[a:b]
                where = self._near(around, where)
            for place in where:
                k = self.passage_of[place]
                if self.owners[k] >= id or done.get((k, at - place), 0) > at:
                    continue
                back, ahead = min(at - low, place - first[k]), min(high - at, first[k + 1] - place)
                wrong = np.flatnonzero(hashes[at - back : at + ahead] != other[place - back : place + ahead])
                cut = int(np.searchsorted(wrong, back))
                start = at - back + (int(wrong[cut - 1]) + 1 if cut else 0)
                end = at - back + (int(wrong[cut]) if cut < len(wrong) else back + ahead)
                done[k, at - place] = max(end, at + 1)
                if end - start >= WINDOW:
                    out += self._runs(texts, start, end, place + start - at)


_SPANS, _REST = "array<struct<s:int,e:int>>", "array<struct<h:long,g:long,p:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_RESULT = f"id long, key long, removed long, kept binary, spans {_SPANS}, rest {_REST}"


def _of_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return _text.mix(hashes.view(np.uint64) + text.astype(np.uint64) * _text.U64(0x9E3779B97F4A7C15))


class Shard:
    """Documents first, then the passages that they may repeat, a bounded number of which is compiled at once."""

    def __init__(self) -> None:
        self.docs: list[tuple[pa.RecordBatch, Texts, list[tuple[int, int]]]] = []
        self.owners: list[np.ndarray] = []
        self.passages: list[pa.Array] = []
        self.chars = 0

    def add_docs(self, rows: pa.RecordBatch) -> None:
        """rows: id, key, text, known (hashes that earlier documents have), spans (found before)."""
        for part in _text.slices(rows.column(2)):
            self.docs.append((rows.slice(part.first, len(part)).select([0, 1, 3, 4]), Texts(part), []))

    def add_passages(self, rows: pa.RecordBatch) -> None:
        """rows: owner, and text in the third column."""
        for part in _text.slices(rows.column(2)):
            self.owners.append(rows.column(0).slice(part.first, len(part)).to_numpy())
            self.passages.append(rows.column(2).slice(part.first, len(part)))
            self.chars += len(part.data)
            if self.chars >= PASSAGE_CHARS:
                self._search()

    def _search(self) -> None:
        if self.chars:
            automaton = Automaton(np.concatenate(self.owners), pa.concat_arrays(self.passages))
            for rows, texts, runs in self.docs:
                runs += automaton.runs(rows.column(0).to_numpy(), texts)
        self.owners, self.passages, self.chars = [], [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._search()
        for rows, texts, runs in self.docs:
            held, covered = np.zeros(len(texts.hashes) + 1, np.int64), np.zeros(len(texts.hashes) + 1, np.int64)
            before = rows.column(3)
            first = np.repeat(texts.first[:-1], before.value_lengths().to_numpy())
            known_spans = [first + before.flatten().field(k).to_numpy() for k in (0, 1)]
            found = np.array(runs, np.int64).reshape(-1, 2)
            for count, (s, e) in ((held, (found[:, 0], found[:, 1] - WINDOW + 1)), (covered, (found[:, 0], found[:, 1])), (covered, known_spans)):
                np.add.at(count, s, 1)
                np.add.at(count, e, -1)
            held, covered = np.cumsum(held[:-1]) > 0, np.cumsum(covered[:-1]) > 0
            edge = np.zeros(len(covered) + 1, bool)
            edge[texts.first] = True
            began = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate(([False], covered[:-1]))))
            ended = np.flatnonzero(covered & (edge[1:] | ~np.concatenate((covered[1:], [False])))) + 1
            owner = texts.text_of(began)
            spans = _lists(_structs(s=(began - texts.first[owner], pa.int32()), e=(ended - texts.first[owner], pa.int32())), owner, len(texts))
            removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[texts.first])
            # Windows that no run holds whole though an earlier document has their marked k-gram.
            at, grams, _ = texts.marks()
            doc, asked = texts.text_of(at), rows.column(2)
            asked_by = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy())
            open_ = ~held[at] & np.isin(_of_text(grams, doc), _of_text(asked.flatten().to_numpy(), asked_by))
            at, doc = at[open_], doc[open_]
            one, two = texts.windows(at)
            rest = _lists(_structs(h=(one, pa.int64()), g=(two, pa.int64()), p=(at - texts.first[doc], pa.int32())), doc, len(texts))
            kept = pa.array(texts.kept(covered), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(removed, pa.int64()), kept, spans, rest], ["id", "key", "removed", "kept", "spans", "rest"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, in it documents (kind 0) before passages (kind 1): shard, kind, id, key, text, known, spans."""
    number, shard = None, Shard()
    for batch in batches:
        both = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)])
        cuts = [0, *(np.flatnonzero((np.diff(both) != 0).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if both[0, a] != number:
                yield from shard.finish()
                number, shard = both[0, a], Shard()
            (shard.add_passages if both[1, a] else shard.add_docs)(batch.slice(a, b - a).select([2, 3, 4, 5, 6]))
    yield from shard.finish()


_PARTS = f"id long, key long, text string, known array<long>, spans {_SPANS}, passage_id long, hashes array<long>, passage string"
_HASHES_ARROW = pa.list_(pa.int64())
_PARTS_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), ("known", _HASHES_ARROW), ("spans", _SPANS_ARROW), ("passage_id", pa.int64()), ("hashes", _HASHES_ARROW), ("passage", pa.string())])


def _part_rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """n rows of _PARTS; null where nothing is given."""
    return pa.RecordBatch.from_arrays([columns[x.name].cast(x.type) if x.name in columns else pa.nulls(n, x.type) for x in _PARTS_ARROW], schema=_PARTS_ARROW)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, text, own (places of hashes, whose windows make passages), known, spans: documents that ask, and passages."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in _text.slices(batch.column(2)):
            rows, texts = batch.slice(part.first, len(part)), Texts(part)
            asks = rows.filter(pc.greater(pc.list_value_length(rows.column(4)), 0))
            yield _part_rows(len(asks), **dict(zip(("id", "key", "text", "known", "spans"), (asks.column(k) for k in (0, 1, 2, 4, 5)), strict=True)))
            owners, ids, hashes, passages = [], [], [], []
            own, sizes = rows.column(3).flatten(), rows.column(3).value_lengths().to_numpy()
            end = np.cumsum(sizes)
            for d in np.flatnonzero(sizes).tolist():
                places = own.slice(int(end[d] - sizes[d]), int(sizes[d]))
                for some, passage in _pieces(texts, d, *(places.field(k).to_numpy() for k in (0, 1, 2))):
                    number += 1
                    owners.append(d)
                    ids.append(number)
                    hashes.append(some)
                    passages.append(passage)
            if owners:
                yield _part_rows(len(owners), id=rows.column(0).take(pa.array(owners)), passage_id=pa.array(ids), hashes=pa.array(hashes, _HASHES_ARROW), passage=pa.array(passages, pa.string()))


def _pieces(texts: Texts, d: int, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
    """Of text d, the windows from starts to ends, each distinct one once: the hashes whose windows a piece holds, and its words."""
    low, high = int(texts.first[d]), int(texts.first[d + 1])
    order = np.argsort(starts, kind="stable")
    hashes, starts, ends = hashes[order], np.maximum(low, low + starts[order]), np.minimum(high, low + ends[order])
    first = np.concatenate(([0], np.maximum.accumulate(ends)[:-1] - WINDOW + 1))
    at = np.concatenate([np.arange(max(s, f), e - WINDOW + 1) for s, f, e in zip(starts.tolist(), first.tolist(), ends.tolist(), strict=True)])
    one, two = (_text.run_hashes(texts.hashes[low:high], WINDOW, family)[at - low] for family in (0, 1))
    order = np.lexsort((at, two, one))
    new = np.ones(len(at), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    at = np.sort(at[order[new]])
    cuts = np.flatnonzero(np.diff(at) >= WINDOW) + 1
    for run in np.split(at, cuts):
        s = int(run[0])
        while s <= run[-1]:
            e = min(int(run[-1]), s + PIECE) + WINDOW
            some = hashes[np.searchsorted(ends, s + WINDOW) : np.searchsorted(starts, e - WINDOW, "right")]
            yield np.unique(some), texts.raw(s, e).decode("utf-8", "surrogatepass")
            s = e - WINDOW + 1


def _round(texts: DataFrame, places: DataFrame, spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stream the documents that ask for a hash through the windows at the places that own it.

    texts: id, key, text; places: id, key, h, s, e, own; spans: id, key, spans found before.
    Returns the results, the documents that were streamed, and the table that these come from.
    """
    own = F.when(F.col("own"), F.struct("h", "s", "e"))
    asks = places.groupBy("id", "key").agg(F.collect_list(own).alias("own"), F.collect_set(F.when(~F.col("own"), F.col("h"))).alias("known"))
    none = F.array().cast(_SPANS)
    asks = asks.withColumn("spans", none) if spans is None else asks.join(spans, ["id", "key"], "left").withColumn("spans", F.coalesce("spans", none))
    rows = _shared.narrowed(texts, asks.select("id"), "id").join(asks.hint("merge"), ["id", "key"]).dropDuplicates(["id", "key"])
    parts = _shared.written(rows.select("id", "key", "text", "own", "known", "spans").mapInArrow(_parts, _PARTS), "parts")
    docs = parts.where("text IS NOT NULL").select("id", "key", "text", "known", "spans")
    size = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("id", "key"), F.lit(max(1, -(-size // SHARD_CHARS)))))
    passages = parts.where("passage IS NOT NULL").select("passage_id", F.col("id").alias("owner"), "hashes", "passage")
    wanted = docs.select("shard", F.explode("known").alias("h")).distinct()
    pairs = wanted.join(passages.select("passage_id", F.explode("hashes").alias("h")), "h").select("shard", "passage_id").distinct()
    sent = pairs.join(passages.drop("hashes"), "passage_id")
    sent = sent.select("shard", F.lit(1).alias("kind"), F.col("owner").alias("id"), F.lit(0).cast("long").alias("key"), F.col("passage").alias("text"), F.array().cast("array<long>").alias("known"), none.alias("spans"))
    rows = docs.select("shard", F.lit(0).alias("kind"), "id", "key", "text", "known", "spans").unionByName(sent)
    found = rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_stream, _RESULT)
    return _shared.written(found, "removed"), docs, parts


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed long, kept_sha256 string, spans array<struct<s int, e int>> of every document.

    Each word is removed that a window of WINDOW words covers whose sequence also starts in a
    document with a smaller id; windows are judged on the input.  spans: the removed word
    intervals.  Words are split at spaces and the five ASCII blanks, and compared unchanged;
    null and empty texts have none; a document of fewer words than a window loses none.  Rows of
    the same id never remove each other's words, and rows with a null id neither lose words nor
    remove any.  Whole texts are read; other columns are not looked at; an empty table gives an
    empty result.
    """
    # A row is known by its id and the hash of its text.
    source = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    prints = _shared.written(source.mapInArrow(_fingerprint, _PRINTS), "prints")
    counted = f"n >= {WINDOW} AND id IS NOT NULL"
    long = prints.where(counted)
    # Of documents with the same words, the one with the smallest id stands for all; the others lose every word.
    # A table of its own, so that the join with it can split the rows of a class of many copies.
    row = F.struct("id", "key")
    classes = long.groupBy("whole").agg(F.min(row).alias("head"), F.max(row).alias("last")).where("head < last")
    classes = _shared.written(classes.select("whole", F.col("head.id").alias("head_id"), F.col("head.key").alias("head_key")), "classes")
    heads = long.groupBy("whole").agg(F.min(F.struct("id", "key", "marks")).alias("r"))
    grams = heads.select("r.id", "r.key", F.explode("r.marks").alias("m")).select("id", "key", F.col("m.h").alias("h"), F.col("m.p").alias("p"))
    shared = _shared.written(grams.groupBy("h").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("owner < most").select("h", "owner"), "shared")
    # Every place of the k-gram in its owner makes a passage: the words around it can differ.
    places = grams.join(shared, "h").select("id", "key", "h", (F.col("p") - (SPAN - 1)).alias("s"), (F.col("p") + WINDOW).alias("e"), (F.col("id") == F.col("owner")).alias("own"))
    places = _shared.written(places, "places")
    first, streamed, parts = _round(source, places)
    _shared.discard(places, shared)
    # Windows that an earlier document's passages should hold but don't.
    rest = first.select("id", "key", F.explode("rest").alias("w")).select("id", "key", "w.h", "w.g", "w.p")
    again = _shared.written(rest.groupBy("h", "g").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("owner < most").select("h", "g", "owner"), "shared")
    places = rest.join(again, ["h", "g"]).select("id", "key", "h", F.col("p").alias("s"), (F.col("p") + WINDOW).alias("e"), (F.col("id") == F.col("owner")).alias("own"))
    places = _shared.written(places, "places")
    second, _, other = _round(streamed.select("id", "key", "text"), places, first.select("id", "key", "spans"))
    _shared.discard(places, again, parts, other)
    more = second.select("id", "key", *(F.col(k).alias(f"{k}_2") for k in ("removed", "kept", "spans")))
    results = first.select("id", "key", "removed", "kept", "spans").join(more, ["id", "key"], "left")
    results = results.select(F.col("id").alias("head_id"), F.col("key").alias("head_key"), *(F.coalesce(f"{k}_2", k).alias(k) for k in ("removed", "kept", "spans")))
    rows = long.select("id", "n", "key", "whole").join(classes, "whole", "left").withColumns({"head_id": F.coalesce("head_id", "id"), "head_key": F.coalesce("head_key", "key")})
    rows = rows.join(results, ["head_id", "head_key"], "left")
    copy = F.col("head_id") < F.col("id")
    every = F.array(F.struct(F.lit(0).alias("s"), F.col("n").cast("int").alias("e")))
    rows = rows.select("id", "n", F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("removed"), F.when(copy, F.lit(bytearray(_EMPTY))).otherwise(F.coalesce("kept", "whole")).alias("kept"), F.when(copy, every).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"))
    short = prints.where(f"NOT ({counted})").select("id", "n", F.lit(0).cast("long").alias("removed"), F.col("whole").alias("kept"), F.array().cast(_SPANS).alias("spans"))
    return rows.unionByName(short).select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.lower(F.hex("kept")).alias("kept_sha256"), "spans")
