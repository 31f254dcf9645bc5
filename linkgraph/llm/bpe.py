"""Byte-level BPE encoding and decoding as a reduction over a monoid.

An encoding of a text is an element; neighbours are joined by re-encoding a window around
their common boundary, which grows until the tokens outside it provably stay as they are:

* Pieces.  A match of the splitting pattern depends on nothing before it, and on no more
  than the three pieces after it.  Once a window reaches four pieces back, what is left of
  it stands; once a re-split boundary coincides with an old boundary on the right, with
  four pieces of the window to spare, what follows stands too.
* Tokens within a piece.  A token sequence is the encoding of its bytes if and only if the
  two tokens of every neighbouring pair are the encoding of that pair's bytes, so a joined
  sequence is right once both seams of the window are such pairs.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a text, and bytes of a piece, that are encoded without halving.
LEAF_CHARS, LEAF_BYTES = 4096, 48
#: Pieces that can still change at the end of a window.
SPARE = 4
#: Pieces whose encoding one worker remembers in each of two generations.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """ranks: from a token's bytes to its id, every single byte among them. pattern: matches are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        self.ranks, self.findall = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.none = max(self.bytes_of, default=0) + 1
        self.pair = lru_cache(1 << 16)(self._pair)

    # Tokens of one piece

    def _merge(self, data: bytes) -> list[int]:
        """By merging the neighbours of the lowest rank, again and again."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        none = self.none
        keys = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while keys:
            low = min(keys)
            if low == none:
                break
            i = keys.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del keys[i]
            if i < len(keys):
                keys[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                keys[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[x] for x in parts]

    def _pair(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        size = 4
        while True:
            middle = left[-size:] + right[:size]
            middle = self._merge(b"".join(map(self.bytes_of.__getitem__, middle)))
            if (size >= len(left) or self.pair(left[-size - 1], middle[0])) and (size >= len(right) or self.pair(middle[-1], right[size])):
                return left[:-size] + middle + right[size:]
            size *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self._merge(data)
        half = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return self.encode_bytes(data) if whole is None else [whole]

    # Pieces of one text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        size = 2 * SPARE
        while left and right:
            back, ahead = left[-size:], right[:size]
            again = self.findall("".join(back) + "".join(ahead))
            if size >= len(right):
                return left[:-size] + again
            boundary, at = 0, sum(map(len, back))
            old, k = {at: 0}, 0
            for k, piece in enumerate(ahead, 1):
                at += len(piece)
                old[at] = k
            for j, piece in enumerate(again[:-SPARE], 1):
                boundary += len(piece)
                if boundary in old:
                    return left[:-size] + again[:j] + right[old[boundary] :]
            size *= 2
        return left or right

    def split(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.split(text[:half]), self.split(text[half:]))

    def encode(self, text: str) -> list[int]:
        return [token for piece in self.split(text) for token in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Digests:
    """Digests of ids and of the bytes that they decode to, with the ids of pieces seen of late remembered."""

    def __init__(self, bpe: TreeBpe) -> None:
        self.bpe, self.young, self.old = bpe, {}, {}

    def piece(self, piece: str) -> tuple[str, list[int]]:
        if piece in self.old:
            found = self.young[piece] = self.old[piece]
            return found
        ids = self.bpe.encode_piece(piece)
        found = ",".join(map(str, ids)), ids
        if len(piece) <= 64:
            self.young[piece] = found
        return found

    def of(self, text: str) -> tuple[int, str, str]:
        if len(self.young) > REMEMBERED:  # what is not met again within a generation is forgotten
            self.young, self.old = {}, self.young
        get = self.young.get
        found = [get(x) or self.piece(x) for x in self.bpe.split(text)]
        ids = list(chain.from_iterable(x[1] for x in found))
        return len(ids), hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest(), hashlib.sha256(self.bpe.decode(ids)).hexdigest()


_coders: dict[tuple[str, str], Digests] = {}


def _coder(path: str, pattern: str) -> Digests:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Digests(TreeBpe(read_ranks(path), pattern))
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id_col, ids array<int>, decoded binary.

    path: a ranks file that every executor can read.  Null encodes as empty, an empty text to
    no ids; repeated rows give repeated results; other columns are not looked at, so their
    names can't clash.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(path, pattern).bpe
        for batch in batches:
            ids = [bpe.encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["key", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", id_col)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but of the ids and bytes only their number and digests.

    id_col, n_tokens long, ids_sha256 string (of the decimal ids joined by commas),
    decoded_sha256 string (of the decoded bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            found = [coder.of(text.as_py() or "") for text in batch.column(1)]
            n, ids, plain = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)
