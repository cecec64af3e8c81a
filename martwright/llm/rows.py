"""Helpers shared by the operators: training folds, Arrow columns, whole texts as word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Bytes of text that are turned into number arrays at once; a longer text stands alone.
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def with_text_column(
    df: DataFrame, text: str, into: str, fn: Callable[[pa.Array], pa.Array], schema: str
) -> DataFrame:
    """``df`` with one column computed from its texts batch by batch; other columns stay in place.

    A column already named ``into`` is replaced. The function sees nulls as nulls.
    """
    # Nondeterministic: a later filter must not make Spark compute the column twice.
    column = arrow_udf(fn, schema).asNondeterministic()
    return df.withColumn(into, column(F.col(text).cast("string")))


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of a string column, cut between rows at about ``most`` bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def hash_sample(df: DataFrame, label: str, most: int, *key: str) -> DataFrame:
    """``most`` rows of each label value, or all it has: those with the smallest hashes of ``key``.

    Counts come first, so that about twice as many rows as are taken reach the task that ranks a
    label's; the driver gets one number for each label value.
    """
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    share = [
        (F.col(label) == r[0]) & (draw < int(min(1.0, (2 * most + 100) / r[1]) * (1 << 40)))
        for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    ]
    some = df.where(reduce(or_, share, F.lit(False)))
    order = Window.partitionBy(label).orderBy(draw, *key)
    return some.withColumn("__rank", F.row_number().over(order)).where(
        F.col("__rank") <= most
    ).drop("__rank")


class Words:
    """The words of some texts as arrays: runs of bytes other than x20 and x09-x0D.

    ``data`` are the UTF-8 bytes of all texts, ``start`` and ``end`` the words' places in it,
    ``first`` the index of each text's first word (one more entry than texts).
    """

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[
            texts.offset : texts.offset + len(texts) + 1
        ]
        self.base = offsets - offsets[0]
        raw = texts.buffers()[2]
        self.data = (
            np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
            if raw is not None
            else np.zeros(0, np.uint8)
        )
        size = len(self.data)
        solid = ~_BLANK[self.data]
        cut = np.zeros(size + 1, bool)
        cut[self.base] = True
        before = np.zeros(size, bool)
        before[1:] = solid[:-1]
        after = np.zeros(size, bool)
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | cut[:-1]))
        self.end = np.flatnonzero(solid & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.base)

    def __len__(self) -> int:
        return len(self.start)

    def of_text(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: Odd multipliers of the polynomial hashes, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(which)
    if known is None or len(known[0]) < size:
        room = max(size, SLICE_BYTES + 1)
        pair = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(room, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        known = (pair[0], pair[1])
        if room <= 4 * SLICE_BYTES:
            _POWERS[which] = known
    return known[0][:size], known[1][:size]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hash of each run ``values[start:end]``; equal runs have equal hashes."""
    up, down = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(words: Words) -> np.ndarray:
    return run_hashes(words.data, words.start, words.end, 0)


def gram_hashes(words: Words, hashes: np.ndarray, size: int, which: int = 1):
    """(text index, first word, hash) of every run of ``size`` words inside one text."""
    count = np.maximum(np.diff(words.first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    skipped = np.cumsum(count) - count
    at = np.arange(len(text)) - skipped[text] + words.first[:-1][text]
    return text, at, run_hashes(hashes, at, at + size, which)
