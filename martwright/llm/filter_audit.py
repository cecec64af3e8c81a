"""What each of several filters removes in every order they may be applied.

Sorted posting lists: per part, and per range of ids within it, each filter has the ascending list
of the documents that fail it, and so have the documents of good quality and the toxic ones. A
range holds at most ``BLOCK`` entries, so a large part becomes many ranges and no task holds a
part. In a range the unions of lists are k-way merges and the differences walk two lists; both
gallop, that is, they jump over runs by doubling steps and copy them whole. Sizes add up over the
ranges, as these do not share documents. What a filter removes depends only on which filters came
before it: 16 sets for each of five filters stand for all 120 orders.

Nulls: a null text is empty, a null part is the empty string, a null id fails no test of copies and
counts as the largest. Rows that share an id are documents of their own; a label counts for all of
them, and one of several label rows is enough. An empty table has no parts and gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.tables import keep, lookup

FILTERS = "ABCDE"
BLOCK = 4096

_BLANKS = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- which filters a document fails ----------------------------------------------------------


def _bits(*failed: Column) -> Column:
    """Failures as bits of one number, the first filter lowest."""
    total = F.lit(0)
    for i, test in enumerate(failed):
        total = total + F.when(test, 1 << i).otherwise(0)
    return total


def failures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, id, fails) for every row; bit i of ``fails`` stands for the i-th of ``FILTERS``.

    A: under 200 words. B: fewer distinct words than half of the words. C: capitals A-Z above three
    in a hundred characters. D: holds a character of ``#$%&*|``. E: the same text has a smaller id
    anywhere in the table; texts are compared by their SHA-256.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(doc_id).cast("long").alias("id"),
        body.alias("body"),
    )
    words = F.array_remove(F.split("body", _BLANKS), "")
    capitals = F.length("body") - F.length(F.translate("body", _CAPITALS, ""))
    own = _bits(
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 3 * F.length("body").cast("long"),
        F.col("body").rlike(r"[#$%&*|]"),
    )
    slim = keep(
        plain.select("part", "id", own.alias("own"), F.unhex(F.sha2("body", 256)).alias("print")),
        "judged",
    )
    first = slim.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    copied = lookup(slim, first.where("n > 1"), ["print"], "n")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return copied.select("part", "id", (F.col("own") + F.when(later, 16).otherwise(0)).alias("fails"))


# --- posting lists ---------------------------------------------------------------------------

_POSTINGS = (
    "part string, ids array<long>, docs array<long>, failing array<array<int>>,"
    " good array<int>, toxic array<int>"
)


def posting_lists(failed: DataFrame, labels: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row per part and range of ids: the ids of its entries in order, how many documents each
    stands for, and the places in this list of what fails each filter, is good, is toxic.

    ``failed``: (part, id, fails). Documents that share part, id and failures are one entry.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    entries = (
        failed.groupBy("part", "id", "fails").agg(F.count("*").alias("docs"))
        .join(marks, "id", "left")
        .select("part", "id", "fails", "docs", F.coalesce("good", F.lit(False)).alias("good"),
                F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )
    order = ["part", F.asc_nulls_last("id"), "fails"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK).to_pydict()
                start = 0
                while start < len(piece["part"]):  # parts lie one after the other
                    part = piece["part"][start]
                    stop = start
                    while stop < len(piece["part"]) and piece["part"][stop] == part:
                        stop += 1
                    fails = piece["fails"][start:stop]
                    yield pa.RecordBatch.from_pylist([{
                        "part": part,
                        "ids": piece["id"][start:stop],
                        "docs": piece["docs"][start:stop],
                        "failing": [[i for i, f in enumerate(fails) if f >> k & 1]
                                    for k in range(filters)],
                        "good": [i for i, g in enumerate(piece["good"][start:stop]) if g],
                        "toxic": [i for i, t in enumerate(piece["toxic"][start:stop]) if t],
                    }], schema=_ARROW)
                    start = stop

    ordered = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(ordered.mapInArrow(lists, _POSTINGS), "postings")


_INTS = pa.list_(pa.int32())
_ARROW = pa.schema([
    ("part", pa.string()), ("ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
    ("failing", pa.list_(_INTS)), ("good", _INTS), ("toxic", _INTS),
])


# --- galloping merges of ascending lists -----------------------------------------------------


def gallop(items: Sequence[int], wanted: int, low: int) -> int:
    """The first place from ``low`` on whose item is ``wanted`` or more, by doubling steps."""
    step, high = 1, low
    while high < len(items) and items[high] < wanted:
        low, high, step = high + 1, high + step, step * 2
    return bisect_left(items, wanted, low, min(high, len(items)))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """All items once. The list with the smallest head gives its run up to the next head."""
    heads = [(items[0], k, 0) for k, items in enumerate(lists) if items]
    heapq.heapify(heads)
    merged: list[int] = []
    while heads:
        item, k, at = heapq.heappop(heads)
        items = lists[k]
        if merged and merged[-1] == item:  # the same item at the head of an earlier list
            stop = at + 1
        else:
            stop = gallop(items, heads[0][0], at) if heads else len(items)
            stop = max(stop, at + 1)
            merged += items[at:stop]
        if stop < len(items):
            heapq.heappush(heads, (items[stop], k, stop))
    return merged


def minus(left: Sequence[int], right: Sequence[int]) -> list[int]:
    """Items of ``left`` that ``right`` lacks."""
    rest: list[int] = []
    i = j = 0
    while i < len(left):
        j = gallop(right, left[i], j)
        if j == len(right):
            rest += left[i:]
            break
        if right[j] == left[i]:
            i += 1
            continue
        stop = gallop(left, right[j], i)
        rest += left[i:stop]
        i = stop
    return rest


def common(left: Sequence[int], right: Sequence[int]) -> list[int]:
    """Items of both."""
    both: list[int] = []
    i = j = 0
    while i < len(left) and j < len(right):
        j = gallop(right, left[i], j)
        if j < len(right):
            if right[j] == left[i]:
                both.append(left[i])
                i += 1
            else:
                i = gallop(left, right[j], i)
    return both


# --- the audit -------------------------------------------------------------------------------

_SUMS = "part string, before int, filter int, kept long, removed long, good_lost long, toxic_lost long"


def removals(postings: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, before, filter) and what the filter removes after those in the bit set ``before``:
    documents kept, removed, and of the removed the good and the toxic ones."""
    names = [f.split()[0] for f in _SUMS.split(", ")]
    schema = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()),
                        *[(n, pa.int64()) for n in names[3:]]])

    everyone = 1 << filters

    def measured(row: dict) -> Iterator[tuple[int, int, int, int, int, int]]:
        docs = row["docs"]
        plain = sum(docs) == len(docs)

        def size(places: Sequence[int]) -> int:
            return len(places) if plain else sum(docs[i] for i in places)

        failing, total = row["failing"], size(range(len(docs)))
        gone = [union([failing[k] for k in range(filters) if mask >> k & 1])
                for mask in range(everyone)]
        for before in range(everyone):
            for k in range(filters):
                if not before >> k & 1:
                    here = minus(failing[k], gone[before])
                    yield (before, k, total - size(gone[before | 1 << k]), size(here),
                           size(common(here, row["good"])), size(common(here, row["toxic"])))

    def told(part: str, sums: dict) -> pa.RecordBatch:
        rows = [(part, *key, *values) for key, values in sums.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, {}
        for batch in batches:
            for i in range(batch.num_rows):  # one range at a time as Python lists
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    if sums:
                        yield told(part, sums)
                    part, sums = row["part"], {}
                for before, k, *values in measured(row):
                    known = sums.get((before, k), (0, 0, 0, 0))
                    sums[before, k] = tuple(a + b for a, b in zip(known, values))
        if sums:
            yield told(part, sums)

    found = postings.mapInArrow(counted, _SUMS)
    sums = [F.sum(n).alias(n) for n in names[3:]]
    return found.groupBy("part", "before", "filter").agg(*sums)


def audit(removed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step.

    kept, removed, redundant (fail this filter, removed earlier), unique_fails (fail this filter
    only), good_lost, toxic_lost, shapley (what the filter removes, over all orders).
    """
    n = len(filters)
    removed = keep(removed, "removed")
    came = F.bit_count("before").cast("int")
    orders_of = F.element_at(  # orders in which exactly these filters come before this one
        F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), came + 1
    )
    alone = came == n - 1  # after all the others
    each = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders_of).alias("shapley"),
    )
    steps = [
        ("".join(filters[k] for k in order), at + 1, sum(1 << k for k in order[:at]), order[at])
        for order in permutations(range(n)) for at in range(n)
    ]
    plan = removed.sparkSession.createDataFrame(
        steps, "filter_order string, step int, before int, filter int"
    )
    # The plan has n * n! rows whatever the data.
    return (
        removed.join(each, ["part", "filter"]).join(F.broadcast(plan), ["before", "filter"])
        .select("part", "filter_order", "step", "kept", "removed",
                (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
                "good_lost", "toxic_lost", "shapley")
    )
