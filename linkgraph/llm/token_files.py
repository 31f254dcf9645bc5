"""Token ids in files of independent Zstandard frames with a trailing seek table.

A file holds, in this order:

* frames: each an independent Zstandard frame of the ids of some whole documents, as
  little-endian unsigned integers of 2 bytes, or 4 where an id needs them;
* an index in a skippable frame: width of an id, and, compressed, an Arrow stream of each
  document's key, first id within the file, number of ids and frame;
* a seek table in a skippable frame, laid out as in Zstandard's public seekable format:
  compressed size, decompressed size and checksum of every frame, then a footer.

A reader takes the footer from the file's end, then the tables, and decompresses only the
frames of the documents asked for.  Checksums are the low 32 bits of XXH64.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from linkgraph.llm import _files, _shared, _text

#: Magic numbers of the public formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Bytes of ids from which a frame is closed; a longer document is a frame of its own.
FRAME_BYTES = 1 << 17
LEVEL = 3
#: Words whose ids one worker remembers in each of two generations, some 25 MB each.
REMEMBERED = 500_000
#: New words that go through the library as one text; texts that it is given at once, for what it returns takes much memory.
TOGETHER, AT_ONCE = 500, 16
#: Bytes of texts that are taken at once.
SLICE_BYTES = 1 << 18
#: Bytes of a word that is remembered.
LONGEST = 500


class ChecksumError(ValueError):
    """A frame or table isn't what its checksum says."""


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Documents in the order in which they are added. width: bytes of an id."""

    def __init__(self, out: BinaryIO, width: int, key_type: pa.DataType) -> None:
        self.out, self.width, self.key_type = out, width, key_type
        self.zip = zstandard.ZstdCompressor(LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[object] = []
        self.counts, self.frame_of = array("q"), array("i")
        self.open: list[bytes] = []
        self.held = 0

    def add(self, key: object, ids: bytes) -> None:
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self._close_frame()
        self.keys.append(key)
        self.counts.append(len(ids) // self.width)
        self.frame_of.append(len(self.frames))
        self.open.append(ids)
        self.held += len(ids)

    def _close_frame(self) -> None:
        data = b"".join(self.open)
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), checksum(data)))
        self.open, self.held = [], 0

    def finish(self) -> None:
        if self.open:
            self._close_frame()
        table = pa.table({"key": pa.array(self.keys, self.key_type), "n": pa.array(self.counts, pa.int64()), "frame": pa.array(self.frame_of, pa.int32())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        index = self.zip.compress(sink.getvalue().to_pybytes())
        index = struct.pack("<BI", self.width, checksum(index)) + index
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)


@dataclass(frozen=True)
class Document:
    key: object
    start: int
    ids: np.ndarray


class Reader:
    """Over a seekable stream. read: frames decompressed so far."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.read = stream, 0
        self.unzip = zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ChecksumError("no seek table at the end")
        table_at = end - 9 - 12 * n - 8
        stream.seek(table_at + 8)
        self.frames = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        stream.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", stream.read(8))
        self.width, check = struct.unpack("<BI", stream.read(5))
        index = stream.read(size - 5)
        if magic != SKIPPABLE or checksum(index) != check:
            raise ChecksumError("the index is damaged")
        table = pa.ipc.open_stream(self.unzip.decompress(index)).read_all().combine_chunks()
        self.keys = table["key"]
        self.counts = table["n"].to_numpy()
        self.frame_of = table["frame"].to_numpy()
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def __len__(self) -> int:
        return len(self.counts)

    def _frame(self, k: int) -> np.ndarray:
        self.stream.seek(int(self.at[k]))
        packed = self.stream.read(int(self.frames[k, 0]))
        try:
            data = self.unzip.decompress(packed, max_output_size=int(self.frames[k, 1]))
        except zstandard.ZstdError as error:
            raise ChecksumError(f"frame {k}: {error}") from error
        if checksum(data) != self.frames[k, 2]:
            raise ChecksumError(f"frame {k} is damaged")
        self.read += 1
        return np.frombuffer(data, f"<u{self.width}")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[Document]:
        """All documents in order, or those of the given places; each frame in turn is decompressed once."""
        now, data = -1, np.zeros(0)
        for i in range(len(self)) if rows is None else rows:
            if (k := int(self.frame_of[i])) != now:
                now, data = k, self._frame(k)
                base = self.starts[np.searchsorted(self.frame_of, k)]
            begin = int(self.starts[i] - base)
            yield Document(self.keys[i].as_py(), int(self.starts[i]), data[begin : begin + int(self.counts[i])].astype("<u4"))

    def find(self, keys: Iterable[object]) -> Iterator[Document]:
        wanted = set(keys)
        yield from self.documents(i for i, key in enumerate(self.keys.to_pylist()) if key in wanted)


class Remembered:
    """Ids of words by 96 bits of hash: an open-addressing table over arrays, and a pool of ids."""

    def __init__(self, dtype: np.dtype, capacity: int) -> None:
        self.capacity, self.slots = capacity, 1 << (2 * capacity - 1).bit_length()
        self.keys, self.checks = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint32)
        self.entry = np.zeros(self.slots, np.int32)
        self.starts, self.counts = np.zeros(capacity, np.int64), np.zeros(capacity, np.int32)
        self.pool = np.zeros(1 << 20, dtype)
        self.n = self.used = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 where it isn't known."""
        out = np.full(len(keys), -1, np.int64)
        slot, open_rows = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(open_rows):
            at = slot[open_rows]
            there = self.keys[at]
            hit = (there == keys[open_rows]) & (self.checks[at] == checks[open_rows])
            out[open_rows[hit]] = self.entry[at[hit]]
            open_rows = open_rows[~hit & (there != 0)]
            slot[open_rows] = (slot[open_rows] + 1) & (self.slots - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entries of new keys, all different, with their ids one after another."""
        entries = np.arange(self.n, self.n + len(keys))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), self.pool.dtype)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[entries], self.counts[entries] = self.used + np.cumsum(counts) - counts, counts
        slot, open_rows = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(open_rows):
            at = slot[open_rows]
            free = self.keys[at] == 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.checks[at[put]], self.entry[at[put]] = keys[open_rows[put]], checks[open_rows[put]], entries[open_rows[put]]
            open_rows = open_rows[~put]
            slot[open_rows] = np.where(self.keys[slot[open_rows]] == 0, slot[open_rows], (slot[open_rows] + 1) & (self.slots - 1))
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        return entries

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and how many each has."""
        counts = self.counts[entries].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[entries] - ends + counts, counts) + np.arange(total)], counts


#: Bytes that are blanks for a splitting pattern, or may be; first bytes of characters that may be.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MAY_LEAD = np.zeros(256, bool)
_MAY_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class PieceEncoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer without a normaliser encodes each match of its splitting pattern by
    itself.  A space or line feed between two characters that are no blanks always begins such
    a match, and that line feed is a match of its own.  So texts are cut there into words, and
    each distinct word goes through the library once, together with others, and is remembered.
    Texts with two blanks in a row, blanks beyond ASCII or very long words go through the
    library whole, and so do all texts of any other tokenizer (byte_level=False).

    special: content of a special token in a text is that token, as the library has it unless
    told otherwise; else it is text like any other.  Texts with an added token's content go
    through the library whole.
    """

    def __init__(self, path: str, byte_level: bool = True, special: bool = False) -> None:
        # Each task has a core; the library reads this before its first text.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        added = [x.content for x in self.library.get_added_tokens_decoder().values() if x.content]
        self.added = [x.encode() for x in added]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        if byte_level and (self.library.normalizer is not None or "ByteLevel(add_prefix_space=False" not in str(self.library.pre_tokenizer)):
            raise ValueError("not a byte-level tokenizer: pass byte_level=False")
        #: Words that are joined could make an added token that holds a blank.
        self.byte_level = byte_level and not any(c.isspace() for x in added for c in x)
        #: Bytes of each token; a byte-level vocabulary writes each byte as one character.
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.size[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.young, self.old = Remembered(self.dtype, REMEMBERED), Remembered(self.dtype, 1)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = (self.library.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False) for i in range(0, len(texts), AT_ONCE))
        return [np.asarray(x.ids, self.dtype) for some in found for x in some]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has.

        Words are joined where they still begin and end matches, then told apart by their bytes.
        """
        alone, joined, parts = [], [], []
        for k, w in enumerate(words):
            if w[-1].isspace() or w[0].isspace() and w[0] != " ":
                alone.append(k)
            else:
                joined.append(k)
                parts.append(w if w[0] == " " else "\n" + w)
        texts = ["".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        ids = np.concatenate([np.zeros(0, self.dtype), *self._whole(texts)]).astype(np.int64)
        ends, wanted = np.cumsum(self.size[ids]), np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in parts])
        stop = np.searchsorted(ends, wanted) + 1
        if len(wanted) and not np.array_equal(ends[stop - 1], wanted):
            raise ValueError("a token crosses words: not a byte-level tokenizer")
        start = np.concatenate(([0], stop[:-1])).astype(np.int64)[: len(stop)]
        start = start + np.array([x[0] == "\n" for x in parts], np.int64)
        single = self._whole([words[k] for k in alone])
        flat = np.concatenate([ids.astype(self.dtype), *single])
        begin, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[joined], counts[joined] = start, stop - start
        counts[alone] = [len(x) for x in single]
        begin[alone] = len(ids) + np.cumsum(counts[alone]) - counts[alone]
        total = np.cumsum(counts)
        return flat[np.repeat(begin - total + counts, counts) + np.arange(int(total[-1]) if len(total) else 0)], counts

    def _entries(self, part: _text.Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word in young; new words are encoded."""
        keys = part.word_hashes(starts, ends, lower=False) | np.uint64(1)
        checks = (part.word_hashes(starts, ends, lower=False, family=1) >> np.uint64(32)).astype(np.uint32)
        entries = self.young.find(keys, checks)
        rows = np.flatnonzero(entries < 0)
        if not len(rows):
            return entries
        _, first, back = np.unique(keys[rows], return_index=True, return_inverse=True)
        if not np.array_equal(checks[rows], checks[rows[first]][back]):  # different words of one key
            both = np.empty(len(rows), [("k", np.uint64), ("c", np.uint32)])
            both["k"], both["c"] = keys[rows], checks[rows]
            _, first, back = np.unique(both, return_index=True, return_inverse=True)
        if self.young.n + len(first) > self.young.capacity:  # what is not met again within a generation is forgotten
            self.young, self.old = Remembered(self.dtype, max(REMEMBERED, len(first))), self.young
            return self._entries(part, starts, ends)
        fresh = rows[first]
        was = self.old.find(keys[fresh], checks[fresh])
        raw = part.data
        new = np.flatnonzero(was < 0)
        words = [raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[fresh[new]].tolist(), ends[fresh[new]].tolist(), strict=True)]
        found = np.zeros(len(fresh), np.int64)
        for which, (ids, counts) in ((new, self._encode_words(words)), (np.flatnonzero(was >= 0), self.old.ids(was[was >= 0]))):
            found[which] = self.young.add(keys[fresh[which]], checks[fresh[which]], ids, counts)
        entries[rows] = found[back.ravel()]
        return entries

    def encode(self, texts: pa.Array, end: bytes) -> Iterator[bytes]:
        """The ids of each text, then end."""
        if not self.byte_level:
            yield from (x.tobytes() + end for text in texts for x in self._whole([text.as_py() or ""]))
            return
        for part in _text.slices(texts, SLICE_BYTES):
            data, edges = part.data, part.offsets
            blank = _BLANK[data]
            odd = np.flatnonzero(blank[1:] & blank[:-1])  # two in a row
            lead = np.flatnonzero(_MAY_LEAD[data])
            lead = lead[lead + 1 < len(data)]
            a, b = data[lead], data[lead + 1]
            odd = np.concatenate((odd, lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)], np.flatnonzero(data == 31)))
            begins = np.zeros(len(data) + 1, bool)
            feed = data == 10
            begins[:-1] = (data == 32) | feed
            begins[1:] |= feed
            begins[edges] = True
            raw = data.tobytes()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    odd = np.append(odd, at)
                    at = raw.find(token, int(edges[np.searchsorted(edges, at, "right")]))
            starts = np.flatnonzero(begins[:-1])
            ends = np.append(starts[1:], len(data))
            odd = np.concatenate((odd, starts[ends - starts > LONGEST]))
            whole = np.zeros(len(part), bool)
            whole[np.searchsorted(edges, odd, "right") - 1] = True
            first = np.searchsorted(starts, edges)
            kept = ~np.repeat(whole, np.diff(first))
            entries = self._entries(part, starts[kept], ends[kept])
            ids, counts = self.young.ids(entries)
            per_word = np.zeros(len(starts), np.int64)
            per_word[kept] = counts
            stop = (np.concatenate(([0], np.cumsum(per_word)))[first] * self.width).tolist()
            flat = ids.astype(self.dtype).tobytes()
            rest = iter(self._whole([data[edges[d] : edges[d + 1]].tobytes().decode("utf-8", "surrogatepass") for d in np.flatnonzero(whole)]))
            for d in range(len(part)):
                yield (next(rest).tobytes() if whole[d] else flat[stop[d] : stop[d + 1]]) + end


_encoders: dict[tuple[str, bool, bool], PieceEncoder] = {}


def _encoder(*how: str | bool) -> PieceEncoder:
    if how not in _encoders:
        _encoders[how] = PieceEncoder(*how)
    return _encoders[how]


SHARDS = "shard int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, path: str, end_id: int, byte_level: bool = True, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> tuple[DataFrame, DataType]:
    """Encode every whole text and write the ids in ascending order of id_col: shard, path, n_docs, n_ids; and the type of the keys.

    Each shard is one file and holds a range of keys; shard numbers ascend with the keys.  Rows
    of the same key are ordered by a hash of their text, null keys come first, a null text is
    empty, and end_id closes every document.  Files of attempts that failed are in no row.
    path: a tokenizer file that every executor can read.  special: as PieceEncoder has it.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or _shared.new_path(spark, "token-ids")
    key_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = _encoder(path, byte_level, special), TaskContext.get()
        end = np.asarray([end_id], encoder.dtype).tobytes()
        batch = next(batches, None)
        while batch is not None and not len(batch):
            batch = next(batches, None)
        if batch is None:
            return
        uri = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        with _files.writing(uri) as out:
            writer = Writer(out, encoder.width, batch.schema.field(0).type)
            while batch is not None:
                for key, ids in zip(batch.column(0), encoder.encode(batch.column(1), end), strict=True):
                    writer.add(key.as_py(), ids)
                batch = next(batches, None)
            writer.finish()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "path": [uri], "n_docs": [len(writer.keys)], "n_ids": [sum(writer.counts)]})

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("tie"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    return _shared.written(rows.mapInArrow(run, SHARDS), "token-shards"), key_type


def read(shards: DataFrame, key_type: DataType, id_col: str = "doc_id") -> DataFrame:
    """From the files: id_col, start (ids of all documents before), n_tokens, ids_crc32, long each.

    Every frame is checked against its checksum.  The shards' totals are summed up on the
    driver: a row for each file.
    """
    spark, start, rows = shards.sparkSession, 0, []
    for x in sorted(shards.collect(), key=lambda x: x.shard):
        rows.append((x.path, start))
        start += x.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                with _files.reading(uri) as stream:
                    keys, starts, counts, sums = [], [], [], []
                    for doc in (reader := Reader(stream)).documents():
                        keys.append(doc.key)
                        starts.append(base + doc.start)
                        counts.append(len(doc.ids))
                        sums.append(zlib.crc32(doc.ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, reader.keys.type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, f"key {key_type.simpleString()}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", id_col)
