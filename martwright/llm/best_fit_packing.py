"""Packing documents into sequences of several permitted lengths, by variable-capacity best fit.

Best fit looks at lengths alone, and there are no more lengths than the longest capacity has
places. So Spark counts the pieces of each length, the packing is planned on the counts - all
pieces of one length at a time, longest first, whole groups of equal bins at once - and Spark then
deals each piece its bin by its number among the pieces of its length. The plan is that of the
usual item-by-item best fit; its size depends on the capacities, not on the number of documents.

The capacities are planned jointly: each set of permitted lengths is tried as what may be opened,
each bin is downsized in the end to the smallest permitted length that holds its contents, and the
plan of least total cost is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from martwright.llm.tables import keep

CAPACITIES = (512, 1024, 2048, 4096)
BLOCKS = 256  # ranks within a length are counted in so many blocks, so that no length is one task


@dataclass
class Plan:
    """For each length, runs of ranks and where they go.

    Row i: pieces of ``size[i]`` with ranks from ``rank[i]`` stand in the bins from ``bin[i]`` on,
    ``per_bin[i]`` in each, the first at ``place[i]``. ``capacity``: runs of bins and their final
    capacities, as (first bin, capacity).
    """

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    place: np.ndarray
    first_bin: np.ndarray
    capacity: np.ndarray
    cost: float


def _default_cost(capacity: int) -> float:
    """Work of a padded sequence: its places, and a part that grows with their square."""
    return capacity * (1 + capacity / 65536)


def _open_for(size: int, opened: Sequence[int], cost: Callable[[int], float]) -> int:
    """The least-cost bin for what comes next: the cost of a place that pieces of this length fill."""
    fits = [c for c in opened if c >= size]
    return min(fits, key=lambda c: (cost(c) / (c // size * size), c))


def plan_packing(
    counts: dict[int, int],
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = _default_cost,
) -> Plan:
    """Best fit of ``counts`` pieces by length, for the cheapest choice of lengths to open."""
    capacities = sorted(set(capacities))
    largest = capacities[-1]
    choices = [
        (*some, largest)
        for r in range(len(capacities))
        for some in combinations(capacities[:-1], r)
    ]
    return min((_best_fit(counts, c, capacities, cost) for c in choices), key=lambda p: p.cost)


def _best_fit(counts, opened, capacities, cost) -> Plan:
    """Longest pieces first; each goes where the least room is left that holds it.

    Bins with the same history are a run [first, first + n) with room left and contents so far.
    A run splits when pieces run out inside it, so there are at most as many runs as lengths more
    than there are openings.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> runs (first bin, n, used)
    rooms: list[int] = []
    done: list[tuple[int, int, int]] = []
    bins = 0

    def put(left: int, run: tuple[int, int, int]) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append(run)

    def place(size: int, rank: int, left: int, first: int, n: int, used: int, pieces: int) -> int:
        """Fill the run's bins one after another with up to ``pieces`` of this length."""
        per = left // size
        full, odd = min(n, pieces // per), 0
        if full:
            rows.append((size, rank, first, per, used))
            put(left - per * size, (first, full, used + per * size))
        if full < n and (odd := pieces - full * per):
            rows.append((size, rank + full * per, first + full, odd, used))
            put(left - odd * size, (first + full, 1, used + odd * size))
        if (idle := n - full - bool(odd)) > 0:
            put(left, (first + full + bool(odd), idle, used))
        return full * per + odd

    for size in sorted(counts, reverse=True):
        pieces, rank = counts[size], 0
        while pieces:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                left = rooms[at]
                first, n, used = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left = _open_for(size, opened, cost)
                n, used, first = -(-pieces // (left // size)), 0, bins
                bins += n
            put_now = place(size, rank, left, first, n, used, pieces)
            rank += put_now
            pieces -= put_now
    for left in rooms:
        done += room[left]
    done.sort()
    sizes = [capacities[bisect_left(capacities, used)] for _, _, used in done]
    total = float(sum(n * cost(c) for (_, n, _), c in zip(done, sizes, strict=True)))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, np.array([d[0] for d in done], np.int64), np.array(sizes, np.int64), total)


def word_count(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pieces_of(lengths: DataFrame, largest: int) -> DataFrame:
    """(id, piece, first, n_words): documents longer than ``largest`` in pieces, none without."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))
    return lengths.where(F.col("n") > 0).select(
        "id", "row", F.posexplode(starts).alias("piece", "first"), "n"
    ).select(
        "id", "row", F.col("piece").cast("long").alias("piece"), "first",
        F.least(F.col("n") - F.col("first"), F.lit(largest).cast("long")).alias("n_words"),
    )


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = _default_cost,
) -> DataFrame:
    """(doc_id, piece, first, n_words, bin, capacity, place): where each piece of each row goes.

    Lengths are words, runs of other than x20 and x09-x0D. A row longer than the largest capacity
    is cut into pieces of that length and a rest. Pieces lie in their bin from ``place`` on and
    never overlap. A null, empty or blank text is one piece 0 of no words with null bin. Rows that
    repeat, or share or lack an id, are packed each for itself. Other columns are not read.
    """
    largest = max(capacities)
    n = word_count(text).cast("long")
    lengths = keep(
        docs.select(F.col(doc_id).alias("id"), n.alias("n"),
                    F.xxhash64(F.col(doc_id), F.col(text)).alias("row")),
        "lengths",
    )
    pieces = pieces_of(lengths, largest).withColumn(
        "block", F.pmod(F.col("row"), F.lit(BLOCKS)).cast("int")
    )
    # Bounded: one row for each length and block.
    counts = pieces.groupBy("n_words", "block").agg(F.count("*").alias("m"))
    found = counts.groupBy("n_words").agg(F.sum("m").alias("m")).collect()
    plan = plan_packing({r["n_words"]: r["m"] for r in found}, capacities, cost)
    before = Window.partitionBy("n_words").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "n_words", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("n_words", "block").orderBy("row", "piece", "id")
    ranked = pieces.withColumn("k", F.row_number().over(order) - 1).join(
        F.broadcast(offsets), ["n_words", "block"]  # at most largest * BLOCKS rows of three numbers
    )
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    @pandas_udf("struct<bin:long, capacity:long, place:long>")
    def deal(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        # (length, rank) as one number; the plan's rows are sorted by it.
        shift = 62 - int(p.size.max()).bit_length()
        at = np.searchsorted(
            (p.size << shift) + p.rank, (size.to_numpy() << shift) + rank.to_numpy(), "right"
        ) - 1
        within = rank.to_numpy() - p.rank[at]
        bin_ = p.bin[at] + within // p.per_bin[at]
        place = p.place[at] + within % p.per_bin[at] * size.to_numpy()
        run = np.searchsorted(p.first_bin, bin_, "right") - 1
        return pd.DataFrame({"bin": bin_, "capacity": p.capacity[run], "place": place})

    dealt = ranked.withColumn("d", deal("n_words", F.col("k") + F.col("offset"))).select(
        F.col("id").alias(doc_id), "piece", "first", "n_words", "d.*"
    )
    nothing = lengths.where(F.col("n") == 0).select(
        F.col("id").alias(doc_id),
        *[F.lit(v).cast("long").alias(c) for c, v in
          zip(("piece", "first", "n_words", "bin", "capacity", "place"), (0, 0, 0, None, None, None),
              strict=True)],
    )
    return dealt.unionByName(nothing)


def bins(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(bin, capacity, used, contents): one row for each sequence, its pieces in order.

    A bin's pieces are bounded by its capacity, for every piece has a word.
    """
    part = F.struct("place", F.col(doc_id).alias("doc_id"), "piece", "first", "n_words")
    return packed.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.max("capacity").alias("capacity"), F.sum("n_words").alias("used"),
        F.sort_array(F.collect_list(part)).alias("contents"),
    )
