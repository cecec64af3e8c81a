"""Byte-level BPE by a tree: encode halves, join neighbours; decode by concatenation up the tree.

Token sequences form a monoid: the product of two encodings is the encoding of the joined bytes.
It is found at the seam. A window of tokens around it is encoded anew and grows until its first
and last token are those that stood there before. Then nothing outside can change: a sequence is
the encoding of its bytes exactly if each two neighbours are the encoding of theirs; inside the
window this holds because it is an encoding, outside and at its ends because these neighbours
stood beside each other in an encoding already.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from martwright.llm.rows import slices, with_text_column

#: Pieces of up to so many bytes are merged directly; longer ones are halved.
LEAF = 4
#: Entries a worker remembers: pieces of text, parts of pieces, seams.
MEMORY = 300_000
NONE = 1 << 60  # a pair that no token joins


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Memory(dict):
    """Answers of a function, kept until there are ``MEMORY`` of them."""

    def __init__(self, answer):
        super().__init__()
        self.answer = answer

    def __missing__(self, key):
        value = self.answer(key)
        if len(self) >= MEMORY:
            self.clear()
        self[key] = value
        return value


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.parts = Memory(self._tree)
        self.seams = Memory(self._seam)
        self.pieces = Memory(self._piece)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, the leftmost of equals, until none can be."""
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        ranks = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < NONE:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NONE)
        return tuple([self.ranks[p] for p in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same by a queue of pairs, for windows of many bytes."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, stop = heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heappush(queue, (r, i, end[stop]))
            if i and (r := get(data[before[i] : stop])) is not None:
                heappush(queue, (r, before[i], stop))
        return tuple([self.ranks[data[i : end[i]]] for i in range(n) if end[i]])

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.part(data[:half]), self.part(data[half:]))

    def part(self, data: bytes) -> tuple[int, ...]:
        return self.parts[data] if len(data) <= 4 * LEAF else self._tree(data)

    def _seam(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.bytes[pair[0]] + self.bytes[pair[1]]) == pair

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The product of two encodings."""
        if not left or not right:
            return left + right
        if self.seams[left[-1], right[0]]:
            return left + right
        a, b = 1, 1
        while True:
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b])))
            loose_left = a < len(left) and window[0] != left[-a]
            loose_right = b < len(right) and window[-1] != right[b - 1]
            if not loose_left and not loose_right:
                return left[: len(left) - a] + window + right[b:]
            a = min(a << loose_left, len(left))
            b = min(b << loose_right, len(right))

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        rank = self.ranks.get(data)
        return self._tree(data) if rank is None else (rank,)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = list(ids)
        level = [b"".join(map(self.bytes.__getitem__, ids[i : i + 1024]))
                 for i in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary) -> Codec:
    """The worker's codec for a broadcast vocabulary, kept from task to task."""
    key, shared = vocabulary
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def share(spark: SparkSession, ranks: dict[bytes, int], pattern: str):
    """Broadcast a vocabulary; its size is fixed and known."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast((ranks, pattern))


def with_tokens(df: DataFrame, vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text, array<int>; null and empty texts have none.

    ``vocabulary``: from ``share``. Each match of its pattern is encoded by itself, special
    tokens are ordinary text. A column named ``into`` is replaced, others pass unread.
    """

    def encode(column: pa.Array) -> pa.Array:
        codec, flat, ends = _codec(vocabulary), [], [0]
        for _, part in slices(column):
            found: list[int] = []
            base = ends[-1]
            for text in part.to_pylist():
                found.extend(codec.encode(text))
                ends.append(base + len(found))
            flat.append(np.array(found, np.int32))
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    return with_text_column(df, text, into, encode, "array<int>")


def with_bytes(df: DataFrame, vocabulary, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``df`` with the bytes that token ids stand for; a null array gives no bytes."""

    def decode(column: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array(
            [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b""
             for x in column], pa.binary()
        )

    return df.withColumn(into, arrow_udf(decode, "binary").asNondeterministic()(F.col(ids)))
